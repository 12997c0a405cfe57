"""Main text of web pages, with wrappers inferred per host as union-free regular expressions."""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corpuscle.llm.common import in_batches, keep

#: Longer pages, and those of more tokens once folded, are not aligned: their own places of text are slots as they stand.
ALIGNED_CHARS = 200_000
ALIGNED_TOKENS = 3000
#: How many wrappers of a host one task aligns at a time, about.
ALIGNED_AT_ONCE = 16

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)|[^<]+|<", re.S)
_RAW = re.compile(r"script|style|noscript|template|iframe|textarea|svg|math|object|title|xmp|noembed", re.I)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_NAMED = re.compile(r"(?:^|[\s_-])(ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|notification|alert|popup|modal|newsletter|subscribe|signup|sidebar|side|aside|menu|nav\w*|breadcrumbs?|toolbar|header|masthead|footer|foot|comments?|replies|disqus|respond|share|sharing|social|related|recommend\w*|widget|search|login|form|pagination|pager|legal|copyright)(?=$|[\s_-])", re.I)
#: Words that go with such a name where it names a part of a frame: inside an article, "share-buttons" is one and "share-price" none.
_FRAME_WORDS = frozenset("list links link buttons button bar block box section container wrapper wrap area inner outer panel items item posts post articles stories content text title heading icons icon form field top bottom left right main global site page ad unit slot".split())
#: Words that an article's own parts are called by as well.
_OWN_WORDS = frozenset("legal side search social respond".split())
_OUT = frozenset("nav header footer aside form menu dialog button select option head script style noscript template iframe textarea svg math object canvas audio video fieldset input label".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_PARAGRAPH = frozenset("p li h1 h2 h3 h4 h5 h6 td dd dt blockquote pre".split())
_SPACE = re.compile(r"\s+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """open, close and text tokens of a page; comments and the content of raw elements are skipped."""
    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[2]:
            name = m[2].lower()
            if m[1]:
                yield "close", name, ""
                continue
            yield "open", name, m[3]
            if m[3].rstrip().endswith("/") or name in _VOID:
                if name not in _VOID:
                    yield "close", name, ""
            elif _RAW.fullmatch(name):
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
                yield "close", name, ""
        elif m[0][0] != "<" or m[0] == "<":
            yield "text", m[0], ""


def _framed(label: str) -> bool:
    """Whether a class or id inside an article names a part of the frame: with all of its words, and not as part of a longer name."""
    for name in label.lower().split():
        words = [w for w in re.split(r"[_-]+", name) if w]
        telling = [w for w in words if _NAMED.fullmatch(w)]
        if telling and all(w in telling or w in _FRAME_WORDS for w in words) and (len(words) > 1 or words[0] not in _OWN_WORDS):
            return True
    return False


def _kind(name: str, attrs: str, inside: bool = False) -> tuple[str, bool]:
    """A tag with its class or id as it stands in a wrapper, and whether it opens a part that is no main text.

    ``inside`` an article or main part, names must be plain ones (``_framed``): what is there is the article's in doubt.
    """
    held = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(attrs)} if attrs.strip() else {}
    label = " ".join(held.get(k, "") for k in ("class", "id", "role")).strip()
    hidden = "hidden" in held or held.get("aria-hidden") == "true" or "display:none" in held.get("style", "").replace(" ", "").lower()
    named = name not in ("html", "body", "article", "main") and (_framed(label) if inside else bool(_NAMED.search(label)))
    return (f"{name}.{'.'.join(label.split())}" if label and name not in ("a", "img") else name), name in _OUT or hidden or named


def events(page: str) -> Iterator[tuple[str, str, bool]]:
    """A page as a well-formed run of open, close and text: implied ends are given, stray ones left out, inline tags dropped.

    An opening carries its tag with class or id as in a wrapper and whether it begins a part outside the main text.
    """
    stack, parts = [], []

    def flush() -> list[tuple[str, str, bool]]:
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        return [("text", text, False)] if text else []

    for kind, name, attrs in tokens(page):
        if kind == "text":
            parts.append(name)
        elif name in _INLINE:
            if name == "br":
                parts.append(" ")
        elif kind == "open":
            yield from flush()
            if name == "p" or (stack and stack[-1] == name and name in ("li", "td", "tr", "dt", "dd", "option")):
                while stack and stack[-1] in ("p", name) and (stack[-1] == "p" or name != "p"):
                    yield "close", stack.pop(), False
            if name not in _VOID:
                yield "open", *_kind(name, attrs, "article" in stack or "main" in stack)
                stack.append(name)
        else:
            yield from flush()
            if name in stack:
                while (top := stack.pop()) != name:
                    yield "close", top, False
                yield "close", name, False
    yield from flush()
    for name in reversed(stack):
        yield "close", name, False


def blocks(page: str) -> list[tuple[tuple[str, ...], bool, str]]:
    """Text blocks in page order: path of open tags, whether a part outside the main text is open, text."""
    return _blocks(events(page))


def _blocks(run: Iterable[tuple[str, str, bool]]) -> list[tuple[tuple[str, ...], bool, str]]:
    out, path, outside = [], [], []
    for kind, what, off in run:
        if kind == "open":
            path.append(what)
            outside.append(off or bool(outside and outside[-1]))
        elif kind == "close":
            path.pop()
            outside.pop()
        else:
            out.append((tuple(path), bool(outside and outside[-1]), what))
    return out


# Wrappers. A token is a string: "<tag>", "</tag>", a fixed text "=..." or "#", the text slot. A group is
# ["+", tokens] (once or more often) or ["?", tokens] (once or not at all). There are no alternatives.


def stream(page: str) -> list[str]:
    """The token stream of a page for alignment; inline tags belong to their text."""
    return list(map(_token, events(page)))


def _token(event: tuple[str, str, bool]) -> str:
    kind, what, _ = event
    return f"<{what}>" if kind == "open" else f"</{what}>" if kind == "close" else "=" + what


def _shape(token) -> str:
    """What alignment compares: any text equals any text, a group its like."""
    if isinstance(token, list):
        return token[0] + "(" + "".join(map(_shape, token[1])) + ")" if token[0] == "?" else "(" + "".join(map(_shape, token[1])) + ")"
    return "#" if token[0] in "=#" else token


def _periods(numbers: np.ndarray, above: int) -> list[int]:
    """Lengths over ``above`` that a repeated unit may have: the distance of many tokens to the next of their like.

    A token that a unit has once stands that far from the next. Lengths with fewer such tokens than an eighth of themselves
    are left out, so that at most the square root of 16 times the tokens are tried.
    """
    order = np.argsort(numbers, kind="stable")
    like = numbers[order[1:]] == numbers[order[:-1]]
    found, n = np.unique((order[1:] - order[:-1])[like], return_counts=True)
    return [int(d) for d in found[(found > above) & (8 * n >= found) & (2 * found <= len(numbers))]]


def fold(seq: list) -> list:
    """Runs of two or more like units become one repeated group, shortest units first; what groups then form folds in turn.

    Only lengths that the distances of like tokens suggest are tried (``_periods``), each with one pass over the page.
    """
    size, shape = 0, [_shape(t) for t in seq]
    numbers = np.unique(np.array(shape, object), return_inverse=True)[1] if seq else np.empty(0, int)
    while periods := _periods(numbers, size):
        for size in periods:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], numbers[:-size] == numbers[size:], [0]]).astype(np.int8)))
            runs = [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= size]  # places like the one a unit on
            out, shapes, at = [], [], 0
            for lo, hi in runs:
                lo, n = max(lo, at), (hi - max(lo, at)) // size + 1
                while n > 1 and isinstance(seq[lo], str) and seq[lo][:2] == "</" and lo + 1 + n * size <= hi + size:  # a unit begins with no closing tag
                    lo += 1
                n = (hi - lo) // size + 1
                unit = seq[lo : lo + size]
                if n < 2 or not any(isinstance(t, list) or t[0] == "<" for t in unit):
                    continue
                for k in range(1, n):
                    unit = [_same(x, y) for x, y in zip(unit, seq[lo + k * size : lo + (k + 1) * size], strict=True)]
                out += [*seq[at:lo], ["+", unit]]
                shapes += [*shape[at:lo], "(" + "".join(shape[lo : lo + size]) + ")"]
                at = lo + n * size
            if out:
                seq, shape = [*out, *seq[at:]], [*shapes, *shape[at:]]
                numbers = np.unique(np.array(shape, object), return_inverse=True)[1]
                size = 0  # lengths are other ones now
                break
        else:
            break
    return seq


def _same(a, b):
    """Two like tokens in one: texts that differ become a slot."""
    if isinstance(a, list):
        return [a[0], [_same(x, y) for x, y in zip(a[1], b[1], strict=True)]]
    return a if a == b else "#"


def align(wrapper: list, page: list) -> list:
    """The least union-free expression found for both: like tokens are merged, a unit that one side has once and
    the other repeats becomes a repeated group, what only one side has becomes optional."""
    plus = lambda seq: [t if isinstance(t, list) and t[0] == "?" else t for t in seq]
    left, right = plus(wrapper), plus(page)
    strip = lambda t: _shape(t[1][0]) if isinstance(t, list) and t[0] == "?" and len(t[1]) == 1 else _shape(t)
    out: list = []
    for op, a, b, c, d in SequenceMatcher(None, [strip(t) for t in left], [strip(t) for t in right], autojunk=False).get_opcodes():
        if op == "equal":
            for x, y in zip(left[a:b], right[c:d], strict=True):
                bare_x = x[1][0] if isinstance(x, list) and x[0] == "?" and len(x[1]) == 1 else x
                bare_y = y[1][0] if isinstance(y, list) and y[0] == "?" and len(y[1]) == 1 else y
                both = _same(bare_x, bare_y)
                out.append(["?", [both]] if bare_x is not x or bare_y is not y else both)
            continue
        one, two = left[a:b], right[c:d]
        for single, other in ((one, two), (two, one)):
            if len(other) == 1 and isinstance(other[0], list) and other[0][0] == "+" and [_shape(t) for t in single] == [_shape(t) for t in other[0][1]]:
                out.append(["+", [_same(x, y) for x, y in zip(single, other[0][1], strict=True)]])
                break
        else:
            for side in (one, two):
                out += [t if isinstance(t, list) and t[0] == "?" else ["?", [t]] for t in side]
    return out


def merged(wrappers: list[list]) -> tuple[list, list[list]]:
    """One wrapper for some of one host, aligned one after the other, and those set aside as they would be too long to align."""
    wrapper: list | None = None
    aside = []
    for seq in wrappers:
        if len(seq) > ALIGNED_TOKENS:
            aside.append(seq)
            continue
        if len(wrapper or ()) > 2 * ALIGNED_TOKENS:
            aside.append(wrapper)
            wrapper = None
        wrapper = seq if wrapper is None else fold(align(wrapper, seq))
    return wrapper or [], aside


def infer(pages: list[str]) -> list:
    """A wrapper for pages of one host, but for those too long to align."""
    return merged([fold(stream(page)) for page in pages])[0]


def slots(wrapper: list, path: list[str] | None = None) -> Iterator[tuple[tuple[str, ...], str | None]]:
    """The places of text in a wrapper, groups included: path of open tags, and the text if it is the same on all pages."""
    path = [] if path is None else path
    for t in wrapper:
        if isinstance(t, list):
            for at, text in slots(t[1], path):
                yield at, text if t[0] == "+" else None
        elif t[0] in "=#":
            yield tuple(path), t[1:] or None
        elif t[1] != "/":
            path.append(t[1:-1])
        else:
            for k in range(len(path) - 1, -1, -1):
                if path[k].split(".")[0] == t[2:-1]:
                    del path[k:]
                    break


def _key(*parts) -> int:
    """A signed 64-bit hash."""
    return int(np.uint64(xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"))).astype(np.int64))


def places(page: str | None) -> tuple[int, list[int]]:
    """A hash of what may be main text, alike for copies in another frame, and one of every block with its path."""
    found = blocks(page or "")
    return _key(*(text for _, out, text in found if not out)), sorted({_key(*path, text) for path, out, text in found if not out})


def _marked(path: tuple[str, ...]) -> bool:
    return any(k.split(".")[0] in ("article", "main") for k in path)


def _around(path: tuple[str, ...]) -> tuple[str, ...]:
    """The element that holds a text's paragraph, item or cell."""
    return path[:-1] if path and path[-1].split(".")[0] in _PARAGRAPH else path


def summary(pages: list[str]) -> dict:
    """What extraction needs of a host's wrapper: which of its slots hold main text, its fixed texts, and the root path.

    A slot is a place of text in the inferred expression, be it single, repeated or optional. Over the pages that the
    wrapper comes from, its texts are weighed: of the slots that no tag, class or role sets outside, those under
    ``article`` or ``main`` hold main text, or where no page has these, those under the path with most text, links not
    counted. Fixed texts, the same on all of three pages or more, are none. Pages with the same main text are one page.
    All is given as hashes of paths and texts.
    """
    pages = list({places(p)[0]: p for p in pages}.values())
    wrapper = infer(pages) if len(pages) > 1 else []
    known = list(slots(wrapper))
    fixed = {_key(*path, text) for path, text in known if text is not None} if len(pages) > 2 else set()
    inside: dict[tuple[str, ...], list[int]] = {}
    for page in pages:
        for path, out, text in blocks(page):
            held = inside.setdefault(path, [0, 0])
            held[0] += len(text) * (not out and _key(*path, text) not in fixed)
            held[1] += out
    marked = any(_marked(p) and n for p, (n, _) in inside.items())
    weight: Counter = Counter()
    for path, (n, _) in inside.items():
        weight[_around(path)] += n
    root = max(weight, key=lambda p: (weight[p], p), default=())
    main = {p: not inside.get(p, [0, 1])[1] and (_marked(p) if marked else p[: len(root)] == root) for p, _ in known}
    return {"main": sorted(_key(*p) for p, yes in main.items() if yes), "other": sorted(_key(*p) for p, yes in main.items() if not yes), "fixed": sorted(fixed), "root": list(root), "marked": marked}


class Wrapper:
    """A host's wrapper as a page is read with it: what ``wrappers`` or ``summary`` found."""

    def __init__(self, learned: dict | None = None, template: Collection[int] = ()):
        learned = learned or {}
        self.slots = {k: True for k in learned.get("main", ())} | {k: False for k in learned.get("other", ())}
        self.fixed = {*learned.get("fixed", ()), *template}
        self.root, self.marked = tuple(learned.get("root", ())), learned.get("marked")
        self.said: dict[tuple[str, ...], bool | None] = {}

    def says(self, path: tuple[str, ...]) -> bool | None:
        """Whether a slot of the wrapper holds main text; None where it has no such slot."""
        if path not in self.said:
            self.said[path] = self.slots.get(_key(*path)) if self.slots else None
        return self.said[path]

    def text(self, page: str | None) -> tuple[str, int, int]:
        """Main text of a whole page, and how many of its blocks the wrapper's slots decided and how many the tags did.

        A block in one of the wrapper's slots is main text as the slot is, unless it is a fixed text of the frame; inside
        ``article`` or ``main`` only what stands before or after all of its own text counts as such. A block where
        the wrapper has no slot is judged by its tags, as all are on a host of one page: parts outside the main text go,
        ``article`` or ``main`` or the host's root path is preferred to the rest. A page of which nothing would be
        left, such as one of many copies, is read by its tags alone.
        """
        found = blocks(page or "")
        sure = [self.says(path) for path, _, _ in found]
        rest = [(path, text) for path, out, text in found if not out]
        marked = any(_marked(path) for path, _ in rest)
        near = lambda path: _marked(path) if marked else path[: len(self.root)] == self.root
        main = [(not out and near(path)) if yes is None or (marked and not self.marked) else yes for (path, out, _), yes in zip(found, sure, strict=True)]
        held = [(path, text) for (path, _, text), yes in zip(found, main, strict=True) if yes]
        drop = [bool(self.fixed) and _key(*path, text) in self.fixed for path, text in held]
        kept = [text for (_, text), off in zip(held, self._at_rim(held, drop), strict=True) if not off]
        kept = kept or [text for path, text in rest if near(path)] or [text for _, text in rest]
        decided = sum(yes is not None for yes in sure)
        return "\n".join(kept), decided, len(found) - decided


    @staticmethod
    def _at_rim(held: list[tuple[tuple[str, ...], str]], drop: list[bool]) -> list[bool]:
        """Which shared texts go. In an article only those before its first own paragraph and after its last own text, and of
        headings only the latter: a heading or a sentence that many articles have among their own text is theirs."""
        heading = [any(re.fullmatch("h[1-6]", p.split(".")[0]) for p in path) for path, _ in held]
        own = [k for k, off in enumerate(drop) if not off]
        first, last = next((k for k in own if not heading[k]), len(drop)), own[-1] if own else -1
        return [off and not (_marked(path) and k < last and (heading[k] or first < k)) for k, ((path, _), off) in enumerate(zip(held, drop, strict=True))]


def main_text(page: str | None, learned: dict | None = None, template: Collection[int] = ()) -> str:
    return Wrapper(learned, template).text(page)[0]


def outline(page: str | None) -> tuple[int, str, list[dict], dict[int, tuple[str, ...]]]:
    """What a page adds to its host's wrapper: a hash of its main text, its wrapper as JSON, its blocks, its paths by hash.

    Blocks: at (hash of the path), place (of path and text), chars, out, first (1 at the first of its path); one for like blocks.
    The wrapper: "w", the folded stream without texts, or "own", hashes of the slots of a page that is too long to align.
    """
    page = page or ""
    run = list(events(page))
    found = _blocks(run)
    paths: dict[int, tuple[str, ...]] = {}
    rows: dict[tuple[int, bool], dict] = {}
    hashes = {path: _key(*path) for path, _, _ in found}
    for path, out, text in found:
        at, place = hashes[path], _key(*path, text)
        row = rows.setdefault((place, out), {"at": at, "place": place, "chars": 0, "out": out, "first": int(at not in paths)})
        row["chars"] += len(text)
        paths[at] = path
    seq = fold([_token(e) if e[0] != "text" else "#" for e in run]) if len(page) <= ALIGNED_CHARS else None
    shape = {"own": sorted(paths)} if seq is None or len(seq) > ALIGNED_TOKENS else {"w": seq}
    return _key(*(text for _, out, text in found if not out)), json.dumps(shape), list(rows.values()), paths


def _joined(shapes: Iterable[str]) -> str:
    """Some wrappers of one host, as ``outline`` gives them, in one."""
    held = [json.loads(x) for x in sorted(shapes)]
    wrapper, aside = merged([x["w"] for x in held if x.get("w")])
    own = {k for x in held for k in x.get("own", ())} | {_key(*path) for seq in aside for path, _ in slots(seq)}
    return json.dumps({"w": wrapper, "own": sorted(own)})


def _outlines(rows: DataFrame) -> DataFrame:
    """``outline`` of every page; a task gives each wrapper and each path of a host once, and may give it again."""
    names = ["__host", "__page", "__shape", "__blocks", "__paths", "__tokens"]
    block = pa.list_(pa.struct([("at", pa.int64()), ("place", pa.int64()), ("chars", pa.int64()), ("out", pa.bool_()), ("first", pa.int64())]))
    named = pa.list_(pa.struct([("at", pa.int64()), ("path", pa.string()), ("around", pa.string()), ("marked", pa.bool_())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[str, int]] = set()
        for b in batches:
            columns: list[list] = [[] for _ in names[1:]]
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                main, tokens_, held, paths = outline(page)
                shape = _key(tokens_)
                new = {at: p for at, p in paths.items() if (host, at) not in given}
                told = [{"at": at, "path": json.dumps(p), "around": json.dumps(_around(p)), "marked": _marked(p)} for at, p in new.items()]
                for column, x in zip(columns, (main, shape, held, told, None if (host, shape) in given else tokens_), strict=True):
                    column.append(x)
                if len(given) > 1 << 19:
                    given.clear()
                given.update((host, at) for at in new)
                given.add((host, shape))
            kinds = (pa.int64(), pa.int64(), block, named, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names)

    schema = "__host string, __page long, __shape long, __blocks array<struct<at: long, place: long, chars: long, out: boolean, first: long>>, __paths array<struct<at: long, path: string, around: string, marked: boolean>>, __tokens string"
    return keep(rows.select("__host", "__html").transform(in_batches, read, schema), "outlines")


def _aligned(shapes: DataFrame) -> DataFrame:
    """__host, __tokens: the wrappers of a host (``__host``, ``__shape`` a hash, ``__tokens``) in one.

    Round by round about ``ALIGNED_AT_ONCE`` of them become one, dealt by hash, so that a host of many wrappers is many tasks'
    and no task holds more than a few; rounds grow with the logarithm of the most that a host has.
    """

    def join(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        one = part["__tokens"].iloc[0] if len(part) == 1 else _joined(part["__tokens"])
        return pd.DataFrame({"__host": [key[0]], "__shape": [_key(one)], "__tokens": [one]})

    while True:
        sizes = keep(shapes.groupBy("__host").agg(F.count("*").alias("__n")), "sizes")
        if sizes.where("__n > 1").isEmpty():
            return shapes.select("__host", "__tokens")
        dealt = shapes.join(sizes, "__host").withColumn("__k", F.pmod("__shape", F.ceil(F.col("__n") / ALIGNED_AT_ONCE)))
        shapes = keep(dealt.groupBy("__host", "__k").applyInPandas(join, "__host string, __shape long, __tokens string"), "shapes")


def wrappers(rows: DataFrame) -> DataFrame:
    """__host, __wrapper and __template of all hosts, from all their pages (``__host``, ``__html``), those with the same main text as one.

    __template: places that more than half of a host's pages share, and three at least. __wrapper: as ``summary`` gives it,
    with the template for fixed texts; slots are of the expression aligned from all pages. A path that a single page has is no
    slot: its tags tell as much. What is counted is hashes, by host and place or path: a host that holds a third of all pages is
    as many entries as it has places. What is gathered a host are its paths of two pages or more, and its template, at most twice the places of a page.
    """
    pages = _outlines(rows)
    found = keep(pages.groupBy("__host", "__page").agg(F.min(F.struct("__shape", "__blocks")).alias("__f")).select("__host", "__f.*"), "places")
    sizes = keep(found.groupBy("__host").agg(F.count("*").alias("__pages")), "sizes")
    held = found.select("__host", F.explode("__blocks").alias("b")).select("__host", "b.*").groupBy("__host", "at", "place", "out")
    held = keep(held.agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("first").alias("first")), "blocks")
    often = held.where("not out and n > 2").join(sizes, "__host").where("2 * n > __pages").select("__host", "place")
    template = often.groupBy("__host").agg(F.to_json(F.sort_array(F.collect_list("place"))).alias("__template"))
    counts = held.join(often.withColumn("fixed", F.lit(True)), ["__host", "place"], "left").groupBy("__host", "at")
    counts = counts.agg(F.sum(F.when(~F.col("out") & F.col("fixed").isNull(), F.col("chars")).otherwise(0)).alias("chars"), F.max("out").alias("out"), F.sum("first").alias("pages"))
    names = pages.select("__host", F.explode("__paths").alias("p")).select("__host", "p.*").distinct()
    paths = keep(counts.join(names, ["__host", "at"]), "paths")
    marked = paths.groupBy("__host").agg(F.max(F.col("marked") & (F.col("chars") > 0)).alias("marked"))
    root = paths.groupBy("__host", "around").agg(F.sum("chars").alias("chars")).groupBy("__host").agg(F.max(F.struct("chars", "around")).alias("r")).select("__host", F.col("r.around").alias("root"))
    lists = paths.where("pages > 1").groupBy("__host").agg(F.to_json(F.collect_list(F.struct("path", "out"))).alias("known"))
    tokens_ = pages.where("__tokens is not null").select("__host", "__shape", "__tokens").distinct()
    several = found.select("__host", "__shape").distinct().join(sizes.where("__pages > 1").select("__host"), "__host", "left_semi")
    shapes = _aligned(keep(several.join(tokens_, ["__host", "__shape"]), "shapes"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for yes, at, listed, shape in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True):
                held, top = json.loads(shape or "{}"), tuple(json.loads(at))
                known = {*held.get("own", ()), *(_key(*p) for p, _ in slots(held.get("w", [])))}
                ruled: dict[bool, list[int]] = {True: [], False: []}
                for row in json.loads(listed or "[]"):
                    p = tuple(json.loads(row["path"]))
                    if (k := _key(*p)) in known:
                        ruled[not row["out"] and (_marked(p) if yes else p[: len(top)] == top)].append(k)
                out.append(json.dumps({"main": sorted(ruled[True]), "other": sorted(ruled[False]), "fixed": [], "root": list(top), "marked": yes}))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), b.column(1)], ["__host", "__wrapper", "__template"])

    every = marked.join(root, "__host").join(template, "__host", "left").join(lists, "__host", "left").join(shapes, "__host", "left")
    every = every.select("__host", "__template", "marked", "root", "known", "__tokens")
    return keep(every.transform(in_batches, learn, "__host string, __wrapper string, __template string"), "wrappers")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id column, url, text (main text, empty if none), n_chars (its code points), by_wrapper and by_tags of every page.

    A host's wrapper is inferred from all of its pages (``wrappers``). Every page of the host, however long, is then read
    whole by the wrapper's slots, in time linear in the page,
    wherever it lies: wrappers are small and joined by host, by broadcast while Spark finds them small and else by a join
    that may split a hot host. ``by_wrapper`` and ``by_tags`` count the blocks that slots decided and that only tags
    did. Null pages are empty, null urls are one host; repeated rows stay, other columns are ignored, an empty table
    gives an empty one.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col), F.col(url_col), host.alias("__host"), F.col(html_col).cast("string").alias("__html"))
    learned = wrappers(rows)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    names = [id_col, url_col, "text", "n_chars", "by_wrapper", "by_tags"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str | None, str | None], Wrapper] = {}
        for b in batches:
            texts, slots_, tags = [], [], []
            for page, *of in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                if (at := tuple(of)) not in known:
                    known[at] = Wrapper(json.loads(at[0] or "null"), json.loads(at[1] or "[]"))
                text, by_wrapper, by_tags = known[at].text(page)
                texts.append(text)
                slots_.append(by_wrapper)
                tags.append(by_tags)
            numbers = [pa.array(x, pa.int64()) for x in ([len(t) for t in texts], slots_, tags)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), *numbers], names)

    joined = rows.join(learned, "__host", "left").select(id_col, url_col, "__html", "__wrapper", "__template")
    return joined.transform(in_batches, read, f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string, n_chars long, by_wrapper long, by_tags long")
