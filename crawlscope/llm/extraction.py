"""Main text of raw HTML by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Elements of HTML by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "select", "button")
BOILERPLATE = frozenset("nav header footer aside form head dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
MAIN = ("article", "main")
# Names of classes and ids that mark what is not the article, where the element holds less than MINOR of the text outside links.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead comment comments disqus reply replies share sharing social "
    "related recommended newsletter subscribe subscription signup login search pagination pager widget toolbar skip copyright legal form".split())
MINOR = 0.5
# Of these, the names of reader comments, notices and adverts reject whatever their element holds, unless a word says how the page is set up.
NEVER = frozenset("ad ads advert adverts advertisement cookie cookies consent gdpr notice popup modal comment comments disqus reply replies newsletter".split())
STATES = frozenset("open closed on off enabled disabled allowed count link free".split())
# Elements that no name marks, and first parts of names that tell of the page's layout.
WHOLE, LAYOUT = frozenset(("html", "body", *MAIN)), frozenset(("has", "no", "with", "without"))
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# An opening tag ends these open siblings first, up to the container that bounds the search.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
            "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?P<end>>|\Z)|<[!?/](?:[^>]*)(?:>|\Z)|<[a-zA-Z][^<]*\Z",
    re.DOTALL)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}
_PART = re.compile(r"[^a-z0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡]")
SMOOTH = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
# A path belongs to the article if its fused ratio reaches this share of the page's spread of ratios.
SPREAD = 0.25
# A path's own ratio, before its neighbours smooth it, must reach this share of the greatest path's, so short junk between paragraphs does not pass.
OWN = 0.05
# The article's element is the deepest one that holds this share of the text of the chosen paths.
HOLDS = 0.8
# Short parts of an article, kept without a content path unless most of their text is links.
PARTS = frozenset("h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption blockquote pre".split())


def _boilerplate(name: str, attrs: str) -> bool:
    if name in BOILERPLATE:
        return True
    if "=" not in attrs and "hidden" not in attrs:
        return False
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES):
            return True
    return False


def _marked(name: str, attrs: str) -> int:
    """1 if a class or id names what is not the article where it holds little text, 2 if it names what never is, else 0."""
    found = 0
    if name in WHOLE or "=" not in attrs:
        return found
    for key, a, b, c in _ATTR.findall(attrs):
        if key.lower() in ("class", "id"):
            for word in (a or b or c).lower().split():
                split = _PART.split(word)
                if word in NEVER or (split[0] not in LAYOUT and NEVER.intersection(split) and not STATES.intersection(split)):
                    return 2
                if word in MARKS or (split[0] not in LAYOUT and any(part in MARKS for part in split)):
                    found = 1
    return found


def text_nodes(page: str) -> tuple[list[tuple[str, str, int, tuple[int, ...], bool]], dict[int, str], set[int], set[int]]:
    """(text, tag path, block, open elements, in a link) per text node outside boilerplate, the names of elements, and those marked:
    where they hold little text, and always. What holds the page's main heading or `<main>` is a wrapper and never always marked."""
    nodes, names, marked, never = [], {}, set(), set()
    stack: list[tuple[str, int, str, bool]] = []  # name, element, path, boilerplate
    block = element = at = 0

    def say(start: int, end: int) -> None:
        if end > start and not (stack and stack[-1][3]):
            piece = html.unescape(page[start:end])
            if piece:
                nodes.append((piece, stack[-1][2] if stack else "", block, tuple(s[1] for s in stack), any(s[0] == "a" for s in stack)))

    def pop(depth: int) -> None:
        nonlocal block
        if any(s[0] not in INLINE for s in stack[depth:]):
            block += 1
        del stack[depth:]

    pos = 0
    while True:
        token = _TOKEN.search(page, pos)
        if token is None:
            say(at, len(page))
            return nodes, names, marked, never
        say(at, token.start())
        at = pos = max(token.end(), token.start() + 1)
        name = (token["name"] or "").lower()
        if not name or not token["end"] == ">":
            continue
        if token["close"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                # an inline end tag does not end the blocks around it
                if name not in INLINE or all(s[0] in INLINE for s in stack[depth:]):
                    pop(depth)
            elif name not in INLINE:
                block += 1
            continue
        if name in CLOSES_P:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)
            if depth is not None:
                pop(depth)
        if name in SIBLINGS:
            ends, bounds = SIBLINGS[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    pop(i)
                    break
                if stack[i][0] in bounds:
                    break
        if name == "body" and any(s[0] == "head" for s in stack):
            pop(next(i for i, s in enumerate(stack) if s[0] == "head"))
        if name in RAW and not token["attrs"].endswith("/"):
            ended = _RAW_END[name].search(page, at)
            at = pos = ended.end() if ended else len(page)
            continue
        if name not in INLINE:
            block += 1
        if name in VOID:
            if name == "br" and not (stack and stack[-1][3]):
                nodes.append((" ", stack[-1][2] if stack else "", block, tuple(s[1] for s in stack), False))
            continue
        if token["attrs"].endswith("/") and name not in INLINE:
            continue
        element += 1
        names[element] = name
        bad = (stack[-1][3] if stack else False) or _boilerplate(name, token["attrs"])
        if name in ("h1", "main"):
            wrapped = never.intersection(s[1] for s in stack)
            never -= wrapped
            marked |= wrapped
        if not bad and (kind := _marked(name, token["attrs"])):
            (never if kind == 2 else marked).add(element)
        stack.append((name, element, f"{stack[-1][2] if stack else ''}/{name}", bad))


def _unmarked(nodes: list[tuple[str, str, int, tuple[int, ...], bool]], marked: set[int]) -> list[tuple[str, str, int, tuple[int, ...], bool]]:
    """The nodes without marked elements that hold a minor share of their text; all nodes if that left no text."""
    if not marked:
        return nodes
    sizes = [0 if n[4] else len(n[0].strip()) for n in nodes]
    if not any(sizes):
        sizes = [len(n[0].strip()) for n in nodes]
    held: dict[int, int] = defaultdict(int)
    for n, s in zip(nodes, sizes, strict=True):
        for e in marked.intersection(n[3]):
            held[e] += s
    minor = {e for e in marked if held[e] < MINOR * sum(sizes)}
    left = [n for n in nodes if not minor.intersection(n[3])]
    return left if any(n[0].strip() for n in left) else nodes


def main_text(page: str | None) -> str:
    """The article of a page: blocks in order, white space folded, joined by one space; empty if there is none.

    Text length and punctuation are summed per root-to-leaf tag path and divided by the path's nodes; each node takes its
    path's two ratios, which are smoothed along the page and fused by multiplication. Paths above a share of the spread are
    content. The deepest element that holds most of their text is the article: it is kept, but for boilerplate
    elements, comments, notices and adverts by name, otherwise marked ones with a minor share of the text, and what lies outside the content paths, unless it shares a block with them or is a heading, list item, cell or
    the like, and no block of links. Where the page names an article, only that is looked at, by the same thresholds.
    """
    nodes, names, marked, never = text_nodes(page or "")
    kept = [n for n in nodes if not never.intersection(n[3])]
    if any(n[0].strip() for n in kept):
        nodes = kept
    else:  # a page that is named so as a whole
        marked |= never
    nodes = _unmarked(nodes, marked)
    # an article or main only narrows the nodes, and only where some of its text is left
    named = False
    for wanted in MAIN:
        group = {e for e, n in names.items() if n == wanted}
        inside = [n for n in nodes if group.intersection(n[3])]
        if any(n[0].strip() for n in inside):
            nodes, named = _unmarked(inside, marked), True
            break
    solid = [n for n in nodes if n[0].strip()]
    if not solid:
        return ""
    # bold, spans and the like belong to the path of their block, links don't
    paths = [n[1] if n[4] else _block_path(n[1]) for n in solid]
    length = np.array([len(n[0].strip()) for n in solid], float)
    # text of links does not speak for its path
    size = np.where([n[4] for n in solid], 0.0, length)
    stops = np.array([0 if n[4] else len(_PUNCTUATION.findall(n[0])) for n in solid], float)
    by_path: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for path, s, p in zip(paths, size, stops, strict=True):
        total = by_path[path]
        total[0] += s
        total[1] += p
        total[2] += 1
    ratio = np.array([[by_path[p][0] / by_path[p][2], by_path[p][1] / by_path[p][2]] for p in paths])
    weight = np.convolve(np.ones(len(solid)), SMOOTH)[2 : 2 + len(solid)]
    smooth = np.column_stack([np.convolve(ratio[:, i], SMOOTH)[2 : 2 + len(solid)] / weight for i in (0, 1)])
    fused = smooth[:, 0] * (1 + smooth[:, 1])
    own = ratio[:, 0] * (1 + ratio[:, 1])
    chosen = (fused >= min(SPREAD * fused.std(), fused.max())) & (own >= OWN * own.max()) if len(solid) > 1 else np.ones(1, bool)
    # a path is chosen as a whole: by most of its text
    share: dict[str, float] = defaultdict(float)
    for p, s, c in zip(paths, length, chosen, strict=True):
        share[p] += s if c else -s
    chosen = np.array([share[p] >= 0 for p in paths])
    if not chosen.any():
        chosen[:] = True
    held: dict[int, float] = defaultdict(float)
    for n, s, c in zip(solid, length, chosen, strict=True):
        if c:
            for e in n[3]:
                held[e] += s
    most = HOLDS * length[chosen].sum()
    article = 0 if named else max((e for e, s in held.items() if s >= most), default=0)
    content = {p for p, c in zip(paths, chosen, strict=True) if c}
    linked: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
    core, parts = set(), set()
    for n, p, s in zip(solid, paths, length, strict=True):
        linked[n[2]][1 if n[4] else 0] += s
        if p in content:
            core.add(n[2])
        elif _block_path(p).rpartition("/")[2] in PARTS:
            parts.add(n[2])
    blocks: dict[int, list[str]] = {}
    for n in nodes:
        if (not article or article in n[3]) and (n[2] in core or not n[0].strip() or (n[2] in parts and linked[n[2]][0] >= linked[n[2]][1])):
            blocks.setdefault(n[2], []).append(n[0])
    return " ".join(t for t in (" ".join("".join(b).split()) for b in blocks.values()) if t)


def _block_path(path: str) -> str:
    """The path without the inline elements at its end."""
    while path.rpartition("/")[2] in INLINE:
        path = path.rpartition("/")[0]
    return path


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page; null html is empty, rows are handled one by one and never dropped.

    Null ids and urls, repeated rows and further columns do no harm; the latter are not read. An empty table stays empty.
    """
    wanted = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema.fields}

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text = [main_text(h if isinstance(h, str) else None) for h in frame["html"]]
            yield frame[["page_id", "url"]].assign(text=text, n_chars=[len(t) for t in text])

    return wanted.mapInPandas(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
