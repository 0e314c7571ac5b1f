"""HTML main-text extraction with wrappers inferred per host.

A page becomes a stream of block tags and text slots; inline tags belong to the text.
Tandem repeats of the stream are folded into repeated groups, which gives the page's
skeleton.  The skeletons of a host are aligned one after the other into a union-free
regular expression, its wrapper: equal tokens stay, tokens that some pages lack become
optional, groups that some pages repeat become repeated, and a text position is a
constant while all pages agree and a text slot once they differ.

Tag and class words name the parts: no text of a menu, header, footer, sidebar, notice, advert,
form or comment list is an article's.  Of a page with ``article`` or ``main``, the slots below them
are; of any other page, those of the host's container with the most varying text outside links, or
of its own one if it holds little or nothing of that.  The wrapper then takes away what is
constant: texts that all pages with a slot share, at least three different pages.

Skeletons are counted before the shuffle, and a host with many of them is merged in groups of
bounded size, level by level, so a host may hold any share of the pages.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, pick, slices

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|svg|iframe|object|select)\b[^>]*>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""",
    re.S | re.I)
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base col embed hr input link meta param source track".split())
#: A start tag closes an open element of these kinds of itself.
CLOSED_BY = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"},
             "dd": {"dt", "dd"}, "option": {"option"}}
#: Elements and class words (also of ids and roles) whose text is no part of an article.
OUTSIDE = frozenset("head nav footer aside form button menu dialog fieldset".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner banners breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies disclaimer disqus footer header masthead menu menubar modal nav navbar navigation "
    "newsletter notice notices notification pagination pager popup promo promotion recommended related reply respond "
    "search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
CONTENT = frozenset("article main".split())
_UNIT = re.compile(r"((?:.){1,24}?)\1+", re.S)


def _label(name: str, attrs: str) -> str:
    """Tag name with the words of its class, id and role; all telling ones, many others in short."""
    if "=" not in attrs:
        return name
    words = set()
    for m in _CLASS.finditer(attrs):
        words.update(_PART.findall(_CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower()))
    telling = words & OUTSIDE_WORDS
    plain = sorted(words - telling)
    if len(plain) > 6:  # the rest only tells labels apart
        plain[6:] = [f"+{xxhash.xxh32_hexdigest(' '.join(plain[6:]))}"]
    return ".".join([name, *sorted(telling), *plain])


def read_page(text: str | None) -> tuple[list[str], list[tuple[str, str, int]]]:
    """Token stream and slots of a page.

    A token is ``<label``, ``>label`` (end) or ``#``; each ``#`` has a slot ``(path, text,
    characters inside links)``.
    """
    tokens: list[str] = []
    slots: list[tuple[str, str, int]] = []
    stack: list[str] = []
    names: list[str] = []
    buf: list[str] = []
    linked, in_link, last = 0, 0, 0
    text = text or ""

    def flush() -> None:
        nonlocal linked
        if buf:
            s = " ".join(html.unescape("".join(buf)).split())
            if s:
                tokens.append("#")
                slots.append(("/".join(stack), s, linked))
            buf.clear()
        linked = 0

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            tokens.append(">" + stack.pop())
            names.pop()

    for m in _TAG.finditer(text):
        if m.start() > last:
            buf.append(text[last:m.start()])
            linked += (m.start() - last) if in_link else 0
        last = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        end = m[2] or m[5]
        if name in INLINE:
            if name == "a":
                in_link = max(0, in_link - 1) if end else in_link + 1
            elif name == "br":
                buf.append(" ")
            continue
        if end:
            flush()
            if name in names:
                close(len(names) - 1 - names[::-1].index(name))
            continue
        flush()
        if "p" in names and names[-1] == "p":
            close(len(names) - 1)
        for k in CLOSED_BY.get(name, ()):
            if names and names[-1] == k:
                close(len(names) - 1)
        if name in VOID:
            continue
        label = _label(name, m[4] or m[7] or "")
        tokens.append("<" + label)
        stack.append(label)
        names.append(name)
    if last < len(text):
        buf.append(text[last:])
    close(0)
    return tokens, slots


def fold(tokens: list[str]) -> tuple[list[str], list[bool], list[int]]:
    """Fold tandem repeats: ``(tokens, repeated, place of each original token in them)``."""
    code: dict[str, str] = {}
    s = "".join(code.setdefault(t, chr(0x100 + len(code))) for t in tokens)
    keep = list(range(len(s)))
    of = list(range(len(s)))  # original -> place in ``keep``
    rep = [False] * len(s)
    while True:
        pieces, new_rep, new_keep, move = [], [], [], [0] * len(s)
        size = last = 0
        for m in _UNIT.finditer(s):
            a, b, u = m.start(), m.end(), len(m[1])
            if u == 1 and m[1] != code.get("#"):
                continue  # nested equal tags are no list
            for i in range(last, a):
                move[i] = size + i - last
            size += a - last
            for i in range(a, b):
                move[i] = size + (i - a) % u
            size += u
            pieces += [s[last:a], m[1]]
            new_rep += rep[last:a] + [True] * u
            new_keep += keep[last:a + u]
            last = b
        if not pieces:
            return [tokens[i] for i in keep], rep, of
        for i in range(last, len(s)):
            move[i] = size + i - last
        s, rep, keep = "".join(pieces) + s[last:], new_rep + rep[last:], new_keep + keep[last:]
        of = [move[i] for i in of]


# A wrapper is a list of nodes [token, repeated, optional, path, text hash (0: varies), pages, characters, linked characters,
# hashes of the texts that all pages share, digests of different pages (the least three)].
TOKEN, REPEATED, OPTIONAL, PATH, TEXT, PAGES, CHARS, LINKED, COMMON, SEEN = range(10)
#: Different pages that must agree before a text is constant.
AGREE = 3


def skeleton(page: str | None) -> tuple[list[list], list[tuple[int, str]]]:
    """A page's wrapper, and its texts as ``(node, text)`` in page order."""
    tokens, slots = read_page(page)
    kept, rep, of = fold(tokens)
    seen = xxhash.xxh32_intdigest("\n".join(text for path, text, _ in slots if not _outside(path)))
    nodes = [[t, r, False, "", 0, 1, 0, 0, [], [seen]] for t, r in zip(kept, rep)]
    texts, k = [], 0
    for i, t in enumerate(tokens):
        if t == "#":
            path, text, linked = slots[k]
            node = nodes[of[i]]
            h = xxhash.xxh32_intdigest(text) or 1
            node[TEXT] = h if not node[CHARS] or node[TEXT] == h else 0
            node[PATH] = path
            node[COMMON].append(h)
            node[CHARS] += len(text)
            node[LINKED] += min(linked, len(text))
            texts.append((of[i], text))
            k += 1
    for node in nodes:
        node[COMMON] = sorted(set(node[COMMON]))
    return nodes, texts


def shape(nodes: list[list]) -> str:
    """What two pages must share to have the same skeleton."""
    return xxhash.xxh3_128_hexdigest("\n".join(f"{n[TOKEN]} {n[REPEATED]:d} {n[PATH]}" for n in nodes))


def add_up(a: list[list], b: list[list]) -> list[list]:
    """Two wrappers with the same tokens as one."""
    return [[x[TOKEN], x[REPEATED] or y[REPEATED], x[OPTIONAL] or y[OPTIONAL], x[PATH] or y[PATH],
             x[TEXT] if x[TEXT] == y[TEXT] else 0, x[PAGES] + y[PAGES], x[CHARS] + y[CHARS], x[LINKED] + y[LINKED],
             sorted(set(x[COMMON]).intersection(y[COMMON])), sorted({*x[SEEN], *y[SEEN]})[:AGREE]]
            for x, y in zip(a, b)]


def align(a: list[list], b: list[list]) -> list[list]:
    """Align two wrappers: common tokens are one, what one of them lacks becomes optional."""
    key = lambda n: (n[TOKEN], n[PATH])
    out: list[list] = []
    for _, a0, a1, b0, b1 in SequenceMatcher(None, [key(n) for n in a], [key(n) for n in b], autojunk=False).get_opcodes():
        if a1 - a0 == b1 - b0 and all(key(x) == key(y) for x, y in zip(a[a0:a1], b[b0:b1])):
            out += add_up(a[a0:a1], b[b0:b1])
        else:
            out += [[*n[:OPTIONAL], True, *n[OPTIONAL + 1:]] for n in a[a0:a1] + b[b0:b1]]
    return gather(out)


def gather(nodes: list[list]) -> list[list]:
    """A run of optional nodes that holds one of them twice becomes one repeated group of its different nodes.

    What free-form pages put between two common tokens thus takes a node for each tag and path, however many
    pages there are.  A gathered slot's constant texts are those that all its members share.
    """
    out: list[list] = []
    for optional, run in groupby(nodes, key=lambda n: n[OPTIONAL]):
        run = list(run)
        different: dict[tuple, list] = {}
        if optional:
            for n in run:
                k = n[TOKEN], n[PATH]
                different[k] = add_up([different[k]], [n])[0] if k in different else n
        out += [[n[TOKEN], True, *n[OPTIONAL:]] for n in different.values()] if 0 < len(different) < len(run) else run
    return out


def expression(nodes: list[list]) -> str:
    """A wrapper as a readable union-free regular expression."""
    out, open_kind = [], ""
    for n in nodes:
        kind = "+" * n[REPEATED] + "?" * n[OPTIONAL]
        if kind != open_kind:
            out += [")" + open_kind] * bool(open_kind) + ["("] * bool(kind)
            open_kind = kind
        out.append(("#const" if n[TEXT] else "#text") if n[TOKEN] == "#" else n[TOKEN])
    return " ".join(out + [")" + open_kind] * bool(open_kind))


def _outside(path: str) -> bool:
    inside = False
    for step in path.split("/"):
        name, *words = step.split(".")
        if name in OUTSIDE or (name == "header" and not inside):
            return True
        if name not in ("html", "body", *CONTENT) and not OUTSIDE_WORDS.isdisjoint(words):
            return True
        inside = inside or name in CONTENT
    return False


def _inside(path: str) -> bool:
    return any(step.split(".")[0] in CONTENT for step in path.split("/"))


def article_slots(wrapper: list[list]) -> set[str]:
    """Paths whose text belongs to the article, decided on the wrapper of a host."""
    slots = [n for n in wrapper if n[TOKEN] == "#" and not _outside(n[PATH])]
    return {n[PATH] for n in slots if _inside(n[PATH])} or container_slots(wrapper)


def _constant(n: list) -> bool:
    return bool(n[TEXT]) and len(n[SEEN]) >= AGREE


def _box(path: str) -> str:
    """The container of a slot; headings and paragraphs count for the one around them."""
    above, _, last = path.rpartition("/")
    return above if last.split(".")[0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre") else path


#: Elements that are part of a running text, not containers of their own.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 hgroup li ul ol blockquote pre td th tr tbody thead tfoot table caption dl dt dd figure figcaption".split())


def _flow(path: str) -> str:
    """The container whose running text a slot is part of."""
    steps = path.split("/")
    while steps and (steps[-1].split(".")[0] in FLOW or steps[-1] == "section"):
        steps.pop()
    return "/".join(steps)


def container_slots(wrapper: list[list]) -> set[str]:
    """Paths of the container that has most of the varying text outside links, of unmarked slots."""
    free = [n for n in wrapper if n[TOKEN] == "#" and not (_outside(n[PATH]) or _inside(n[PATH]) or _constant(n))
            and n[LINKED] <= n[CHARS] / 2]
    mass: dict[str, int] = {}
    for n in free:
        mass[_box(n[PATH])] = mass.get(_box(n[PATH]), 0) + n[CHARS]
    if not mass:
        return set()
    best = max(sorted(mass), key=lambda k: mass[k])
    return {n[PATH] for n in free if n[PATH] == best or n[PATH].startswith(best + "/")}


def _key(path: str, h: int) -> int:
    """A text at a path as a signed long."""
    return xxhash.xxh64_intdigest(f"{h} {path}") - (1 << 63)


def constant_texts(wrapper: list[list]) -> set[int]:
    """Keys of the texts that all pages with a slot share, at least ``AGREE`` different ones."""
    return {_key(n[PATH], h) for n in wrapper if n[TOKEN] == "#" and len(n[SEEN]) >= AGREE for h in n[COMMON]}


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").lower()).split("/")[0].split("?")[0].split("#")[0]


def _wrapper_rows(pages: DataFrame) -> DataFrame:
    """``(host, shape, wrapper)``: the skeletons of each host, equal ones added up within a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", 16 << 20):
            got: dict[tuple[str, str], list] = {}
            for url, page in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
                nodes, _ = skeleton(page)
                k = host_of(url), shape(nodes)
                got[k] = add_up(got[k], nodes) if k in got else nodes
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.string()), pa.array([k[1] for k in got], pa.string()),
                                              pa.array([json.dumps(v) for v in got.values()], pa.string())],
                                             names=["host", "shape", "wrapper"])

    return pages.select("url", "html").mapInArrow(run, "host string, shape string, wrapper string")


def _merge(key, t: pa.Table) -> pa.Table:
    """Align the wrappers of one group, the most frequent shapes first."""
    all_w = [json.loads(w) for w in t.column("wrapper").to_pylist()]
    by: dict[str, list] = {}
    for s, w in sorted(zip(t.column("shape").to_pylist(), all_w), key=lambda x: x[0]):
        by[s] = add_up(by[s], w) if s in by and len(by[s]) == len(w) else w
    out: list[list] | None = None
    for w in sorted(by.values(), key=lambda w: (-max((n[PAGES] for n in w), default=0), json.dumps(w))):
        out = w if out is None else align(out, w)
    return pa.table([pa.array([key[0].as_py()]), pa.array([shape(out or [])]), pa.array([json.dumps(out or [])])],
                    names=["host", "shape", "wrapper"])


def host_wrappers(pages: DataFrame, group: int = 64) -> DataFrame:
    """``(host, wrapper)``: one wrapper a host, merged level by level in groups of about ``group`` skeletons."""
    w = materialize(_wrapper_rows(pages), "wrappers")
    while True:
        sizes = w.groupBy("host").agg(F.count(F.lit(1)).alias("size"))
        most = sizes.agg(F.max("size")).first()[0]
        if not most or most == 1:
            return w.select("host", "wrapper")
        parts = F.ceil(F.col("size") / F.lit(group)).cast("int")
        w = materialize(
            w.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("shape", "wrapper"), parts).cast("int"))
            .groupBy("host", "part").applyInArrow(lambda k, t: _merge(k, t), "host string, shape string, wrapper string"), "wrappers")


def extract_articles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                     broadcast_bytes: int = 16 << 20) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per input row.

    A null or empty page has empty text.  Pages without a host (null url) share no container.
    Repeated rows give repeated results.  The rules go to the pages of a host by a join; it is a
    broadcast only if all of them together are measured below ``broadcast_bytes``.
    """
    d = pick(pages, page_id=id_col, url=url_col, html=html_col)
    wrappers = host_wrappers(d)

    def decide(batches):
        for b in batches:
            hosts = b.column("host").to_pylist()
            made = [json.loads(w) for w in b.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("host"), pa.array([sorted(container_slots(w)) if h else [] for h, w in zip(hosts, made)], pa.list_(pa.string())),
                 pa.array([sorted(constant_texts(w)) for w in made], pa.list_(pa.int64()))], names=["host", "paths", "constants"])

    rules = materialize(wrappers.mapInArrow(decide, "host string, paths array<string>, constants array<long>"), "rules")
    total = rules.agg(F.sum(F.length("host") + F.length(F.array_join("paths", ",")) + 8 * F.size("constants") + 64)).first()[0] or 0
    block = "path string, text string, key long, flow string, box string, mass long, marked boolean"
    schema = T.StructType([T.StructField("page_id", d.schema["page_id"].dataType), T.StructField("url", T.StringType()),
                           T.StructField("host", T.StringType()),
                           T.StructField("blocks", T.ArrayType(T.StructType.fromDDL(block)))])
    kind = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("key", pa.int64()), ("flow", pa.string()), ("box", pa.string()),
                               ("mass", pa.int64()), ("marked", pa.bool_())]))

    def read(batches):
        for b in slices(batches, "html", 16 << 20):
            hosts, blocks = [], []
            for url, page in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
                hosts.append(host_of(url))
                blocks.append([{"path": p, "text": t, "key": _key(p, xxhash.xxh32_intdigest(t) or 1), "flow": _flow(p), "box": _box(p),
                                "mass": len(t) if min(n, len(t)) <= len(t) / 2 else 0, "marked": _inside(p)}
                               for p, t, n in read_page(page)[1] if not _outside(p)])
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(hosts, pa.string()),
                                              pa.array(blocks, kind)], names=schema.names)

    def varying(c):
        """Without the constant texts of containers that hold nothing else, unless nothing else is there at all."""
        free = F.filter(c, lambda x: ~F.array_contains("constants", x["key"]))
        flows = F.array_distinct(F.transform(free, lambda x: x["flow"]))
        v = F.filter(c, lambda x: ~F.array_contains("constants", x["key"]) | F.array_contains(flows, x["flow"]))
        return F.when(F.size(free) > 0, v).otherwise(c)

    mass = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["mass"])
    below = lambda c, box: F.filter(c, lambda x: (x["path"] == box) | x["path"].startswith(F.concat(box, F.lit("/"))))
    found = d.mapInArrow(read, schema).join(F.broadcast(rules) if total <= broadcast_bytes else rules, "host", "left")
    # one projection a step: nothing is worked out twice
    found = found.withColumn("inside", F.filter("blocks", lambda x: x["marked"]))
    found = found.withColumn("some", varying(F.when(F.size("inside") > 0, F.col("inside")).otherwise(F.col("blocks"))))
    found = found.withColumn("host_part", F.filter("some", lambda x: F.array_contains("paths", x["path"])))
    boxes = F.array_distinct(F.transform(F.filter("some", lambda x: x["mass"] > 0), lambda x: x["box"]))
    own = F.array_max(F.transform(boxes, lambda k: F.struct(mass(F.filter("some", lambda x: x["box"] == k)).alias("mass"), k.alias("box"))))
    found = found.withColumn("own", F.when(F.size("inside") == 0, own))
    kept = (F.when(F.size("inside") > 0, F.col("some")).when(2 * mass(F.col("host_part")) >= F.coalesce("own.mass", F.lit(0)), F.col("host_part"))
            .otherwise(F.filter(below(F.col("some"), F.col("own.box")), lambda x: x["mass"] > 0)))
    text = F.array_join(F.transform(kept, lambda x: x["text"]), "\n")
    return found.select("page_id", "url", F.coalesce(text, F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
