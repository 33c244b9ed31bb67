"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import sub_batches

#: Blocks on either side and width of the smoothing, share of the best path's value that a content path reaches,
#: share of links from which a path is a menu, share of a page's text that its landmarks hold to be taken for it.
RADIUS, WIDTH, SHARE, LINKS, LANDMARK = 2, 1.0, 0.25, 0.5, 0.2
#: Elements nested deeper are read at this depth, as browsers do.
DEPTH = 512

# Fixed values of HTML: elements that lay out blocks, that hold no elements, and whose content is not markup.
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary svg table tbody td template "
    "tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe xmp noembed noframes".split())
#: Elements that an opening tag closes where they are open within the given bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that are never an article's text, and landmarks of the main text.
NEVER = set("aside button dialog footer form head iframe menu nav noscript optgroup option select svg template".split())
MAIN = {"article", "main"}
HEADINGS = {f"h{k}" for k in range(1, 7)}
#: Leaves that belong to the text around them however short they are.
PROSE = HEADINGS | set("p ul ol li dl dt dd blockquote pre table thead tbody tr td th caption figure figcaption".split())
#: Words of class, id and role that name what is not an article's text; those of the second line even where articles are inside.
ASIDE = set(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies "
    "copyright disclaimer footer gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification notifications "
    "overlay pager pagination popup popular promo promoted promotion share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription "
    "toolbar topbar trending widget widgets".split()
)
APART = set("comment comments commentlist discussion disqus recommended recommendations related replies reply respond".split())
#: Titles of the readers' part where nothing else names it.
READERS = re.compile(r"\W*(\d+ )?(reader |user )?(comments?|kommentare?|commentaires?|comentarios?)( \(?\d+\)?)?\W*", re.I)

TOKEN = re.compile(r"<!--(?:.*?-->|.*)|</?([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>?", re.S)
UNCLOSED = re.compile(r"<!--|</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile("[.,;:!?…。、，！？؟،؛।]")


P, P_BOUNDS = {"p"}, {"td", "th", "table", "caption", "button"}
#: End tags in a cell don't reach beyond it, but for those of the table's own elements.
CELLS, TABLE = {"td", "th", "caption"}, set("html body table thead tbody tfoot tr td th caption".split())


def _kind(tag: str, attributes: dict[str, str]) -> str:
    """What an element is if it isn't the article's: "never" its text, its page's "header", or "aside" unless it frames the article."""
    if not attributes:
        return ("aside" if tag == "form" else "never") if tag in NEVER else "header" if tag == "header" else ""
    if tag in NEVER or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return "aside" if tag == "form" else "never"
    words = {w.lower() for k in ("class", "id", "role") if k in attributes for w in WORD.findall(attributes[k])}
    if tag not in ("html", "body") and words & APART:
        return "never"
    if tag == "header":
        return "header"
    return "aside" if words & ASIDE and tag not in ("html", "body", "main", "article", "p") and tag not in HEADINGS else ""


class _Block:
    """A run of text on one tag path: the path's elements, the element that holds it, and the marks of those around it."""

    __slots__ = ("apart", "chars", "landmark", "links", "path", "punctuation", "text")

    def __init__(self, path: tuple, text: str, links: int, apart: tuple, landmark: int | None) -> None:
        self.path, self.text, self.links, self.apart, self.landmark = path, text, links, apart, landmark
        self.chars, self.punctuation = len(text), len(PUNCTUATION.findall(text))


class _Element:
    __slots__ = ("apart", "landmark", "name", "path", "tag")

    def __init__(self, tag: str, name: str, over: _Element | None) -> None:
        self.tag, self.name = tag, name
        self.path = (*over.path, name) if over else (name,)
        self.apart, self.landmark = (over.apart, over.landmark) if over else ((), None)


def blocks_of(page: str) -> list[_Block]:
    """Blocks of text in page order with their root-to-leaf tag paths, without what is marked as apart from the article:
    elements of NEVER, a page's header (of an article's only headings are its text), and elements whose class, id or role
    says so. An element of ASIDE stays if an article, a main part or a first heading is inside, as it is a frame of the page then."""
    out: list[_Block] = []
    stack: list[_Element] = [_Element("", "", None)]
    held: dict[str, int] = {}  # elements on the stack by tag
    text: list[str] = []
    state = {"link": False, "links": 0}
    pushed: set[str] = set()  # elements that lay out no block but are apart
    marks: list[str] = []  # of what each mark is: "never", "aside", "header" or "framed"

    def flush() -> None:
        if not text:
            return
        joined = " ".join("".join(text).split())
        if joined:
            top = stack[-1]
            out.append(_Block(top.path, joined, min(state["links"], len(joined)), top.apart, top.landmark))
        text.clear()
        state["links"] = 0

    def close(tags: set, bounds: set) -> None:
        if not any(held.get(t) for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                flush()
                for e in stack[k:]:
                    held[e.tag] -= 1
                del stack[k:]
                return
            if stack[k].tag in bounds:
                return

    def said(piece: str) -> None:
        plain = html.unescape(piece) if "&" in piece else piece
        text.append(plain)
        if state["link"]:
            state["links"] += len(plain.strip())

    def start(tag: str, rest: str) -> None:
        if tag == "br":
            text.append("\n")
            return
        attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)} if rest and not rest.isspace() else {}
        if tag == "a":
            state["link"] = "href" in attributes
            return
        kind = _kind(tag, attributes)
        if tag in BLOCKS:
            flush()
            state["link"] = False
            close(P, P_BOUNDS)
            if tag in CLOSES:
                close(*CLOSES[tag])
        elif kind:
            flush()
            pushed.add(tag)
        else:
            return
        if tag in VOID or len(stack) > DEPTH:
            return
        first = re.sub(r"\d+", "", attributes["class"].split(" ")[0]) if "class" in attributes else ""
        e = _Element(tag, f"{tag}.{first}" if first else tag, stack[-1])
        if (tag in MAIN or tag == "h1") and not kind:
            for k in e.apart:
                if marks[k] == "aside" and (tag != "h1" or not any(marks[j] == "header" for j in e.apart)):
                    marks[k] = "framed"
        if tag in MAIN and e.landmark is None and not kind:
            e.landmark = len(out)
        if kind:
            # An article's own header keeps its headings.
            marks.append("own" if kind == "header" and e.landmark is not None else kind)
            e.apart = (*e.apart, len(marks) - 1)
        stack.append(e)
        held[tag] = held.get(tag, 0) + 1

    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        m = TOKEN.search(page, at) if at <= last else None
        if m is None:
            said(UNCLOSED.split(page[at:], maxsplit=1)[0])
            break
        if m.start() > at:
            said(page[at : m.start()])
        at = m.end()
        tag = (m[1] or m[3] or "").lower()
        if not tag:
            continue
        if page[m.start() + 1] == "/":
            if tag == "a":
                state["link"] = False
            elif tag in BLOCKS or tag in pushed:
                flush()
                state["link"] = False
                close({tag}, set() if tag in TABLE else CELLS)
            continue
        if tag in RAW:
            flush()
            over = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = over.end() if over else end
            continue
        start(tag, m[2] if m[1] else m[4] or "")
    flush()
    kept = []
    for b in out:
        kinds = {marks[k] for k in b.apart}
        heading = "own" in kinds and any(n.partition(".")[0] in HEADINGS for n in b.path)
        if not kinds or not kinds & {"never", "aside", "header"} and ("own" not in kinds or heading):
            kept.append(b)
    return _without_readers(kept)


def _without_readers(blocks: list[_Block]) -> list[_Block]:
    """Without the parts that a heading of their own calls the readers' comments."""
    shut: set[tuple] = set()
    out = []
    for b in blocks:
        if b.path[-1][:1] == "h" and b.path[-1].partition(".")[0] in HEADINGS and READERS.fullmatch(b.text) and len(b.path) > 1 and b.path[-2].partition(".")[0] in ("section", "div"):
            shut.add(b.path[:-1])
        if not shut or not any(b.path[: len(s)] == s for s in shut):
            out.append(b)
    return out


KERNEL = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * WIDTH**2))


def _smooth(values: np.ndarray) -> np.ndarray:
    """Means under a normal curve of the values around each place, by columns."""
    padded = np.pad(np.column_stack([values, np.ones(len(values))]), ((RADIUS, RADIUS), (0, 0)))
    sums = sum(w * padded[k : k + len(values)] for k, w in enumerate(KERNEL))
    return sums[:, :-1] / sums[:, -1:]


def path_values(blocks: list[_Block]) -> dict[tuple, tuple[float, float]]:
    """Of each tag path its fused value and its share of links. Text and punctuation are summed by path and divided by its
    blocks; the blocks take their path's ratios, which are smoothed in page order and averaged by path again. The value is the
    geometric mean of the two ratios (punctuation's plus one), as they are and smoothed, times the share that isn't links."""
    places: dict[tuple, int] = {}
    of = np.array([places.setdefault(b.path, len(places)) for b in blocks])
    counts = np.bincount(of)
    chars, punctuation, links = (np.bincount(of, weights=[getattr(b, c) for b in blocks]) for c in ("chars", "punctuation", "links"))
    smooth = _smooth(np.column_stack([chars / counts, punctuation / counts])[of])
    text, marks = (np.bincount(of, weights=smooth[:, k]) / counts for k in (0, 1))
    share = links / chars
    value = (chars / counts * text * (1 + punctuation / counts) * (1 + marks)) ** 0.25 * (1 - share)
    return {path: (value[k], share[k]) for path, k in places.items()}


def main_text(page: str | None) -> str:
    """The text of a page's article, one space between its blocks.

    Paths whose value reaches SHARE of the best one's are content. So are short leaves (headings, lists, tables) below the container of a
    content path that are not mostly links, between the first content block and the last or as a heading before. Where articles or the main part are marked
    and hold enough of the text, nothing outside is, and inside everything that is not mostly links."""
    if not page:
        return ""
    blocks = blocks_of(page)
    marked = [b for b in blocks if b.landmark is not None]
    if sum(b.chars for b in marked) >= LANDMARK * sum(b.chars for b in blocks):
        blocks = marked or blocks
    if not blocks:
        return ""
    values = path_values(blocks)
    most = max(v for v, _ in values.values())
    content = {p for p, (v, share) in values.items() if v >= SHARE * most and share < LINKS}
    holders = {p[:-1] if p[-1].partition(".")[0] in PROSE else p for p in content}
    chosen = [b.path in content for b in blocks]
    if not any(chosen):
        return ""
    first, last = chosen.index(True), len(chosen) - chosen[::-1].index(True)

    def beside(k: int, b: _Block) -> bool:
        if b.links >= LINKS * b.chars:
            return False
        if b.landmark is not None:
            return True
        leaf = b.path[-1].partition(".")[0]
        for d in range(len(b.path), 0, -1):
            if b.path[:d] in holders and all(n.partition(".")[0] in PROSE for n in b.path[d:]):
                return first <= k < last or (leaf in HEADINGS and k < first)
        return leaf == "h1" and k < first

    return " ".join(b.text for k, b in enumerate(blocks) if chosen[k] or beside(k, b))


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``*keep, text, n_chars``: one row per page with the text of its article and its code points.

    Pages that are null, empty or hold no article give an empty text. Each row is read by itself and whole, in sub-batches
    of about 2 MB of markup or one page, so equal pages and repeated ids stay as they are. Other columns are ignored,
    also those named like the result's; an empty table gives an empty result."""
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "__html"):
            texts = [main_text(p) for p in batch.column(len(keep)).to_pylist()]
            own = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{types}, text string, n_chars long")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
