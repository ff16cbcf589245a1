"""A tolerant reader of HTML: one pass over a page, in time linear in its length."""

import html
import re
from collections.abc import Iterator

# Elements without content, those whose content is plain text, those that end a
# line of text, and what closes an open element without a tag of its own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
ENDS_WITH = {"li": ("li", "ul ol menu"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}

_CLOSERS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS_WITH.items()}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/A-Za-z][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")


def attributes(text: str) -> dict[str, str]:
    """A tag's attributes, names in lower case; the first of a name counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return out


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") in page order; text
    is decoded. Comments, declarations, a tag that the page's end cuts off, and the content of
    scripts, styles and the like are left out (a title's is text)."""
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            text = page[at:stop]
            yield "text", html.unescape(text) if "&" in text else text, ""
        if not m:
            return
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3]
        if name in RAW:
            close = re.compile(f"</{name}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, at)
            if name in ("title", "textarea") and (close.start() if close else end) > at:
                yield "text", html.unescape(page[at : close.start() if close else end]), ""
            yield "close", name, ""
            at = close.end() if close else end


class Elements:
    """The open elements while a page is read. `opened` and `closed` tell which elements (by
    their place in `frames`) a tag begins or ends, those without a closing tag included."""

    def __init__(self) -> None:
        self.open: list[tuple[str, object]] = []
        self.counts: dict[str, int] = {}

    def push(self, name: str, what: object) -> None:
        self.open.append((name, what))
        self.counts[name] = self.counts.get(name, 0) + 1

    def pop(self) -> object:
        name, what = self.open.pop()
        self.counts[name] -= 1
        return what

    def implied(self, name: str) -> list[object]:
        """What an opening tag closes by the way: a paragraph before a block, a list's item
        before the next one."""
        out = []
        if name in BLOCK and self.counts.get("p"):
            while self.open and self.open[-1][0] not in BLOCK and any(n == "p" for n, _ in self.open[-8:]):
                out.append(self.pop())
            if self.open and self.open[-1][0] == "p":
                out.append(self.pop())
        if name in _CLOSERS:
            those, within = _CLOSERS[name]
            if any(self.counts.get(t) for t in those):
                k = len(self.open) - 1
                while k >= 0 and self.open[k][0] not in those and self.open[k][0] not in within:
                    k -= 1
                if k >= 0 and self.open[k][0] in those:
                    while len(self.open) > k:
                        out.append(self.pop())
                    if name == "tr" and self.open and self.open[-1][0] == "tr":
                        out.append(self.pop())
        return out

    def close(self, name: str) -> list[object]:
        """What a closing tag ends: its element and all that are open within; nothing if none is open."""
        out: list[object] = []
        if self.counts.get(name):
            while True:
                last = self.open[-1][0]
                out.append(self.pop())
                if last == name:
                    return out
        return out


def inner_by_class(page: str, wanted: list[tuple[str, bool]]) -> list[list[str]]:
    """For each (css, whole) of `wanted` the inner HTML of all elements with such a class, in
    the order they begin: a class that begins with one of css's alternatives (parted by `|`), or
    with `whole` false one that holds it. Open elements of a name are counted, so that an
    element ends where its depth is reached again, however deep, long or wide it is; one that
    is never closed ends with the page."""
    out: list[list[tuple[int, str]]] = [[] for _ in wanted]
    ways = [(css.lower().split("|"), whole) for css, whole in wanted]
    depth: dict[str, int] = {}
    within: dict[str, list[tuple[int, int, int]]] = {}  # by name: depth, which of `wanted`, begin
    at, end = 0, len(page)
    while m := _TOKEN.search(page, at):
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            now, held = depth.get(name, 0), within.get(name, [])
            while held and held[-1][0] == now:
                _, k, begin = held.pop()
                out[k].append((begin, page[begin : m.start()]))
            depth[name] = max(0, now - 1)
        elif name in RAW:
            close = re.compile(f"</{name}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = close.end() if close else end
        elif name not in VOID:
            depth[name] = depth.get(name, 0) + 1
            if "class" in m[3].lower():
                classes = attributes(m[3]).get("class", "").lower()
                for k, (css, whole) in enumerate(ways):
                    if any(c.startswith(x) for c in classes.split() for x in css) if whole else any(x in classes for x in css):
                        within.setdefault(name, []).append((depth[name], k, at))
    for held in within.values():
        for _, k, begin in held:
            out[k].append((begin, page[begin:]))
    return [[text for _, text in sorted(found, key=lambda f: f[0])] for found in out]
