"""HTML extraction by equivalence-class template deduction.

1. Every page becomes a sequence of tokens: *tags* (an element's path: tag names with their classes
   and ids from the root, running numbers in names read as ``#``) and *texts* (a text block together with the path it
   stands in).  Spark counts each token on each page and folds its occurrence vector over the pages
   of a host (how often it stands on which page) into a hash.
2. Tokens of a host with the same occurrence vector form an equivalence class.  A class is valid if
   it stands on enough of the host's pages (``SUPPORT``) and nests: each of its tokens stands in an
   element of a valid class (or at the root).  Its tokens are ordered by position; a page whose
   tokens of the class come in another order is no instance of it.  Valid classes, nested by path,
   are the host's template; what lies between their tokens are its slots.
3. A text token of a valid class that also holds a tag token is constant text of the template
   (``TEXT_PAGES``, ``TEXT_SUPPORT``): it does not count for the choice of the main slot, and is cut
   from the pages that are instances of its class.
4. The main slot is the template element that holds most of the host's varying text outside links
   and furniture, found from the root downwards.  Names (article, main, a content class) only say
   where the descent ends; furniture names (sidebar, share ...) drop an element by its own name, but
   never one that holds most of the varying text (``DOMINANT``) while no article, main or content
   element stands outside it, and reader comments only yield if there is no other text.
5. Each page is cut along its host's template: the text of the main slots without furniture
   (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments) and
   without constant text.

A host with a single page, or a page that lacks its host's main slot or holds more than
``OWN_FACTOR`` times its text in a slot of its own, is judged by the page alone.  A page whose main
slot would lose more than half of its text to constant text keeps it: it is a copy, no furniture.

Output text: character references decoded, white space inside a block one space, blocks trimmed
and joined by one ``\n``; nothing is capped.

Edge cases: null or empty html gives empty text; a null url counts as host ""; tags left open are
closed by what encloses them; ``page_id`` may be null or repeat.  Extra columns are ignored.

Scale: the template statistics are one row per (page, token) with map-side combine, so a host that
holds a third of all pages is no single task; a template holds at most ``page tokens / SUPPORT``
tokens; pages meet their host's template in a salted equi-join, so the pages of a hot host are
spread over many tasks.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SUPPORT = 0.3
#: constant text: distinct pages and share of the host's pages that its class must stand on
TEXT_PAGES = 8
TEXT_SUPPORT = 0.5
#: a child takes the descent over, or a furniture name is overruled, from this share of the varying text
DOMINANT = 0.8
OVERRULED = 0.5
OWN_FACTOR = 2
SALTS = 64
#: fixed values: element names by role, and name parts that mark page furniture or main content
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
RAW = "script|style|noscript|template|iframe|svg|math|object|textarea|title"
DROPPED_TAGS = frozenset("nav footer aside button select option textarea dialog menu head title header".split())
SOFT_TAGS = frozenset(["form"])
FURNITURE = re.compile(
    r"(?:^|[-_])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|notices?|consent|popup|modal|sidebar|nav|navbar|navigation|menu|breadcrumbs?|share|social|"
    r"related|recommend\w*|newsletter|subscribe|comments?|replies|disqus|footer|masthead|toolbar|pagination|pager)(?:$|[-_])", re.I)
COMMENTS = re.compile(r"(?:^|[-_])(?:comments?|replies|disqus)(?:$|[-_])", re.I)
#: names that start like this say what the layout has or lacks, not what the element is
LAYOUT = re.compile(r"(?:no|has|with|without|not|is|hide|show)[-_]", re.I)
CONTENT = re.compile(r"(?:^|[-_])(?:content|article|post|entry|story|body|text|main)(?:$|[-_])", re.I)
CONTAINERS = frozenset("html body main article section div td table tbody tr center form fieldset".split())
#: a start tag of the key closes an open element of the values
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<(?P<raw>{RAW})\b[^>]*>(?:.*?</(?P=raw)\s*>|.*$)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][a-z0-9:-]*)(?P<attrs2>[^>]*)>", re.I | re.S)
DIGITS = re.compile(r"(?<=[-_])[0-9]{2,}")         # running numbers, as in post-1234
ATTRIBUTE = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.I)


def own_names(names: list[str], pattern: re.Pattern) -> bool:
    return any(pattern.search(n) and not LAYOUT.match(n) for n in names)


class Element:
    """An open element; ``hard``: furniture by tag, role or visibility, ``soft``: by its own name."""
    __slots__ = ("tag", "path", "hard", "soft", "shut")

    def __init__(self, tag: str, attrs: str, parent: Element | None):
        found, hidden, role = [], False, ""
        if attrs.strip():
            for m in ATTRIBUTE.finditer(attrs):
                key, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
                if key in ("class", "id"):
                    found += DIGITS.sub("#", value).replace("/", "_").replace(".", "_").split()
                elif key == "role":
                    role = value.lower()
                elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                    hidden = True
        self.tag = tag
        mark = "!" if hidden or role in ("navigation", "banner", "contentinfo", "complementary", "search") else ""
        self.path = f"{parent.path if parent else ''}/{tag}{mark}{'.' + '.'.join(sorted(found)) if found else ''}"
        self.hard, self.soft = judged(tag + mark, found, parent is not None and "/article" in parent.path)
        self.shut = False


def judged(tag: str, names: list[str], in_article: bool) -> tuple[bool, bool]:
    """Whether an element is furniture by its tag (``!``: hidden or a role of furniture), by its names."""
    hard = tag.endswith("!") or (tag in DROPPED_TAGS and not (tag == "header" and in_article))
    return hard, tag in SOFT_TAGS or (tag not in ("html", "body", "article", "main") and own_names(names, FURNITURE))


def stream(page: str) -> Iterator[tuple[str, Element | None, str]]:
    """``("open", element, "")``, ``("close", element, "")``, ``("text", innermost, text)`` and
    ``("link" / "unlink", innermost, "")`` in page order."""
    stack: list[Element] = []
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield "text", stack[-1] if stack else None, page[at: m.start()]
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing = (m["end"] if m["tag"] else m["end2"]) == "/"
        if tag == "a":
            yield "unlink" if closing else "link", stack[-1] if stack else None, ""
        elif tag in ("br", "hr", "img", "wbr"):
            yield "text", stack[-1] if stack else None, " "
        if tag not in BLOCKS or tag == "hr":
            continue
        if closing:
            if any(e.tag == tag for e in stack):
                while True:
                    e = stack.pop()
                    yield "close", e, ""
                    if e.tag == tag:
                        break
            continue
        if stack and stack[-1].tag == "p":
            yield "close", stack.pop(), ""
        while stack and stack[-1].tag in CLOSES.get(tag, ()):
            yield "close", stack.pop(), ""
        e = Element(tag, (m["attrs"] if m["tag"] else m["attrs2"]) or "", stack[-1] if stack else None)
        stack.append(e)
        yield "open", e, ""
    if at < len(page):
        yield "text", stack[-1] if stack else None, page[at:]
    while stack:
        yield "close", stack.pop(), ""


def key_of(path: str, text: str = "") -> int:
    """64-bit key of a tag token, or of a text token of that path."""
    return int.from_bytes(blake2b(f"{path}\n{text}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def blocks(page: str) -> Iterator[tuple[str, Element | None, str, int]]:
    """``("open" / "close", element, "", 0)`` and ``("text", innermost, block, characters in links)``."""
    parts: list[str] = []
    linked, in_links = False, 0
    at: Element | None = None
    for kind, e, text in stream(page):
        if kind == "text":
            parts.append(text)
            at = e
            in_links += len(text.strip()) if linked else 0
        elif kind in ("link", "unlink"):
            linked = kind == "link"
        else:
            if parts:
                text = " ".join(html_lib.unescape("".join(parts)).split())
                if text:
                    yield "text", at, text, min(in_links, len(text))
                parts.clear()
                in_links = 0
            yield kind, e, "", 0
    text = " ".join(html_lib.unescape("".join(parts)).split())
    if text:
        yield "text", at, text, min(in_links, len(text))


def page_tokens(page: str) -> dict[tuple[str, int], list[int]]:
    """Per token ``(path, 0)`` or ``(path, key of the text)``: occurrences, position of the first,
    characters of text in it, characters of these in links.  ``("", 0)`` is the page."""
    out: dict[tuple[str, int], list[int]] = {("", 0): [1, 0, 0, 0]}
    open_ = [out["", 0]]
    for at, (kind, e, text, linked) in enumerate(blocks(page), 1):
        if kind == "open":
            row = out.setdefault((e.path, 0), [0, at, 0, 0])
            row[0] += 1
            open_.append(row)
        elif kind == "close":
            open_.pop()
        else:
            path = e.path if e else ""
            row = out.setdefault((path, key_of(path, text) or 1), [0, at, 0, 0])
            row[0] += 1
            for row in (*open_, row):
                row[2] += len(text)
                row[3] += linked
    return out


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 5)
    for batch in batches:
        rows = []
        for host, mark, page in zip(*(batch.column(c).to_pylist() for c in ("host", "mark", "html"))):
            rows += [(host, mark, path, text, *v) for (path, text), v in page_tokens(page or "").items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                         names=["host", "mark", "path", "text", "n", "at", "chars", "linked"])


def _parts(path: str) -> list[str]:
    steps = path.split("/")[1:]
    return ["/" + "/".join(steps[:k]) for k in range(1, len(steps) + 1)]


def _last(path: str) -> tuple[str, list[str]]:
    tag, *names = path.rsplit("/", 1)[-1].split(".")
    return tag, names


def choose(elements: dict[str, tuple[int, int]]) -> tuple[list[str], list[str]]:
    """Main slots and the furniture names that are overruled, of ``path → (characters, of these in
    links)`` of a template's varying text (or of one page's text)."""
    def flags(path):
        return judged(*_last(path), "/article" in path.rpartition("/")[0])

    def weight(path):
        return max(elements[path][0] - elements[path][1], 0)

    paths = sorted((p for p in elements if p), key=lambda p: (p.count("/"), p))
    hard = [p for p in paths if flags(p)[0]]
    seen = [p for p in paths if not any(q == p or p.startswith(q + "/") for q in hard)]
    soft = [p for p in seen if flags(p)[1]]

    def tops(found):
        return [p for p in found if not any(p.startswith(q + "/") for q in found)]

    def net(path, gone):
        return weight(path) - sum(weight(q) for q in tops([q for q in gone if q.startswith(path + "/")]))

    clean = [p for p in seen if not any(q == p or p.startswith(q + "/") for q in soft)]
    marked = [p for p in clean if (_last(p)[0] in ("article", "main") or own_names(_last(p)[1], CONTENT)) and net(p, soft + hard) > 0]
    whole = max((net(p, hard) for p in tops(seen)), default=0)
    released: list[str] = []
    for p in soft:                                       # outermost first
        if any(p.startswith(q + "/") and q not in released for q in soft):
            continue
        scopes = [q for q in marked if p.startswith(q + "/")]
        total = net(scopes[-1], hard) if scopes else whole
        share = net(p, hard)
        if own_names(_last(p)[1], COMMENTS):
            keep = share >= total
        else:
            keep = share > OVERRULED * total and (bool(scopes) or not marked)
            keep = keep and (not scopes or share >= DOMINANT * total)
        if keep and share > 0:
            released.append(p)
    shut = hard + [p for p in soft if p not in released]
    free = {p: net(p, shut) for p in seen if not any(q == p or p.startswith(q + "/") for q in shut)}
    free = {p: n for p, n in free.items() if n > 0}
    roots = tops([p for p in free if _last(p)[0] in CONTAINERS])
    if not roots:
        return tops(list(free)), released
    # siblings without a common container: the one that holds the most text
    at = max(roots, key=lambda p: (free[p], p))
    while True:
        tag, names = _last(at)
        below = [p for p in free if p.startswith(at + "/") and _last(p)[0] in CONTAINERS and free[p] >= DOMINANT * free[at]]
        articles = [p for p in below if _last(p)[0] == "article"]
        if tag == "article":
            break
        inside = [p for p in tops([p for p in free if p.startswith(at + "/") and _last(p)[0] == "article"])]
        if not articles and sum(free[p] for p in inside) >= DOMINANT * free[at]:
            return inside, released                      # several articles share the text
        mains = [p for p in below if _last(p)[0] == "main" or own_names(_last(p)[1], CONTENT)]
        if tag == "main" or own_names(names, CONTENT):
            below = articles
        step = tops(articles) or tops(mains) or tops(below)
        if not step:
            break
        at = max(step, key=lambda p: (free[p], p))
    return [at], released


def extract(page: str, mains: list[str], released: list[str] = (), orders: list[list[int]] = ()) -> tuple[str, int] | None:
    """Text of the main slots (path "": the whole page) and its varying characters outside links;
    null if the page has none of them.  ``orders``: template classes with constant text, as ordered keys."""
    wanted, kept = set(mains), set(released)
    inside = int("" in wanted)
    found = inside > 0
    stack: list[Element] = []
    first: dict[int, int] = {}
    watched = {k for o in orders for k in o}
    out: list[tuple[str, int, int]] = []                 # block, its key, characters outside links
    for at, (kind, e, text, linked) in enumerate(blocks(page)):
        if kind == "open":
            e.shut = bool(stack and stack[-1].shut) or e.hard or (e.soft and e.path not in kept)
            stack.append(e)
            if e.path in wanted:
                inside += 1
                found = True
            if watched:
                first.setdefault(key_of(e.path), at)
        elif kind == "close":
            stack.pop()
            if e.path in wanted:
                inside -= 1
        else:
            path = e.path if e else ""
            key = (key_of(path, text) or 1) if watched else 0
            first.setdefault(key, at)
            if inside and not (e and e.shut):
                out.append((text, key, len(text) - linked))
    if not found:
        return None
    constant = set()
    for o in orders:
        places = [first.get(k, -1) for k in o]
        if places[0] >= 0 and all(a < b for a, b in zip(places, places[1:])):     # an instance of the class
            constant.update(o)
    rest = [b for b in out if b[1] not in constant]
    if constant and 2 * sum(len(b[0]) for b in rest) >= sum(len(b[0]) for b in out):
        out = rest
    return "\n".join(b[0] for b in out), sum(b[2] for b in rest)


def page_text(page: str | None, plan: dict | None) -> str:
    if not page:
        return ""
    plan = plan or {}
    hosted = extract(page, plan["mains"], plan["released"], plan["orders"]) if plan.get("mains") else None
    own_mains, own_released = choose({p: (v[2], v[3]) for (p, text), v in page_tokens(page).items() if not text})
    own = extract(page, own_mains, own_released, plan.get("orders", ())) if own_mains else None
    if hosted is not None and (own is None or own[1] <= OWN_FACTOR * hosted[1] or own_mains == plan["mains"]):
        return hosted[0]
    if own is None:                                       # a page without block elements
        own = extract(page, [""])
    return own[0]


PLAN = pa.struct([("mains", pa.list_(pa.string())), ("released", pa.list_(pa.string())), ("orders", pa.list_(pa.list_(pa.int64())))])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [page_text(page, plan) for page, plan in zip(batch.column("html").to_pylist(), batch.column("plan").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=["id", "url", "text", "n_chars"])


def templates(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``host, host_pages, classes`` for ``pages(host, mark, html)``: equivalence classes that stand on
    enough pages, each with its tokens ``(at, path, text, chars, linked)`` in order (text 0: a tag)."""
    tokens = pages.mapInArrow(_token_rows, "host string, mark long, path string, text long, n long, at long, chars long, linked long")
    # the occurrence vector (page → count) of a token, folded into one order-free hash
    vector = tokens.groupBy("host", "path", "text").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("mark", "n")).alias("vector"),
        F.avg("at").alias("at"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    vector = checkpointed(vector.where("pages > 1"))
    hosts = vector.where("path = '' AND text = 0").select(F.col("host").alias("h"), F.col("pages").alias("host_pages"))
    often = vector.where("path <> ''").join(hosts, F.col("host") == F.col("h")).where(F.col("pages") >= F.lit(support) * F.col("host_pages"))
    # a token that repeats a different number of times than its page is of an inner class; a class of texts alone is no template
    classes = often.groupBy("host", "host_pages", "pages", "total", "vector").agg(
        F.max(F.col("text") == 0).alias("tagged"),
        F.sort_array(F.collect_list(F.struct("at", "path", "text", "chars", "linked"))).alias("tokens")).where("tagged")
    return classes.groupBy("host", "host_pages").agg(F.sort_array(F.collect_list(F.struct("pages", "total", "tokens")), asc=False).alias("classes"))


def plan_of(host_pages: int, classes: list[dict], text_pages: int = TEXT_PAGES, text_support: float = TEXT_SUPPORT) -> dict:
    """Main slots, overruled names and the ordered classes with constant text of one host."""
    tags = {t["path"]: (t["chars"], t["linked"]) for c in classes for t in c["tokens"] if not t["text"]}
    nested = {p for p in tags if all(q in tags for q in _parts(p))}
    constant, orders = [], []
    for c in classes:
        tokens = c["tokens"]
        texts = [t for t in tokens if t["text"] and t["path"] in nested]
        if texts and c["pages"] >= max(text_pages, text_support * host_pages) and all(t["path"] in nested for t in tokens):
            constant += texts
            orders.append([t["text"] or key_of(t["path"]) for t in tokens])
    varying = {p: list(tags[p]) for p in nested}
    for t in constant:
        for p in _parts(t["path"]):
            varying[p][0] -= t["chars"]
            varying[p][1] -= t["linked"]
    mains, released = choose({p: (v[0], v[1]) for p, v in varying.items()})
    before = choose({p: tags[p] for p in nested})
    if sum(tags[p][0] for p in before[0]) and sum(varying[p][0] for p in mains) * 10 < sum(tags[p][0] for p in before[0]):
        (mains, released), orders = before, []            # pages of one text: copies, not furniture
    return {"mains": mains, "released": released, "orders": orders}


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [plan_of(n, classes) for n, classes in zip(batch.column("host_pages").to_pylist(), batch.column("classes").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, PLAN)], names=["host", "plan"])


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, ``text``, ``n_chars``."""
    url = F.col(url_col)
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    p = pages.select(F.col(id_col).alias("id"), url.alias("url"), F.col(html_col).alias("html"), host.alias("host"),
                     F.xxhash64(F.col(id_col), url).alias("mark"))
    plans = checkpointed(templates(p.select("host", "mark", "html")).mapInArrow(
        _plans, "host string, plan struct<mains: array<string>, released: array<string>, orders: array<array<long>>>"))
    # pages of one host are dealt to SALTS groups, each of which gets a copy of the host's short plan
    salt = F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")
    dealt = plans.select(F.col("host").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"), "plan")
    joined = (p.select("id", "url", "html", "host", salt.alias("salt"))
              .join(dealt, (F.col("host") == F.col("h")) & (F.col("salt") == F.col("s")), "left").select("id", "url", "html", "plan"))
    types = dict(pages.dtypes)
    out = joined.withColumn("id", F.col("id").cast("long")).mapInArrow(_texts, "id long, url string, text string, n_chars long")
    return out.select(F.col("id").cast(types[id_col]).alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
