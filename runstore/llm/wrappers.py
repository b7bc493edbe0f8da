"""Main text of pages by wrappers: union-free regular expressions inferred for each host.

A page is read as a stream of tags and text slots. Squares in the stream (a group that follows
itself) fold into repeated groups, so pages of a host have few different shapes. The shapes are
aligned one after the other with the host's wrapper: equal parts meet, and a part that only one
side has becomes optional. There are no alternatives, so a wrapper is a sequence of tags, slots,
repeated groups and optional parts. It grows with the number of different shapes, not of pages.

A slot is labelled by the elements of its own page that it stands in. Where a page has no article
container, the wrapper decides: a slot whose whole text is the same on all of the host's pages, and
on several that differ elsewhere, belongs to the template; its place is found by aligning the
page's shape with the wrapper. A page's text is that of its slots that carry content.

Tasks fold their own pages first, so a host of any size is merged from a few partial wrappers.
Wrappers are broadcast up to ``BROADCAST_BYTES`` in all; beyond, pages and wrappers are joined.

Pages are folded in the order in which a task reads them, so of two wrappers that align equally well
either may come out; whether a slot is constant does not depend on that order.

Nulls and odd input: null html is empty and has no text. A very long page costs memory for its own
tokens. Ties between alignments go to the page's earlier part. A null url, or one without a host,
belongs to the host ``''``. Unclosed tags and stray brackets are read as browsers would. Repeated
pages give repeated rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep

BROADCAST_BYTES = 8 << 20
FOLD = 12  # longest group that folds
CONSTANT_PAGES = 3  # different pages on which a slot has the same text before it counts as template text
# HTML's containers, its inline elements, and the names that mark other matter.
VOID = frozenset("area base br col embed hr img input link meta param source track".split())
# Elements that end an open paragraph, and those that end an open sibling, as far as the nearest of the others.
AFTER_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section table ul".split())
_LISTS, _CELLS = frozenset("ul ol menu".split()), frozenset("td th".split())
SIBLINGS = {"li": (frozenset(["li"]), _LISTS), **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), frozenset(["dl"])))}
SIBLINGS |= {"tr": (frozenset(["tr"]), frozenset(["table"])), **dict.fromkeys(_CELLS, (_CELLS, frozenset(("tr", "table")))), "option": (frozenset(["option"]), frozenset(["select"]))}
SIBLINGS |= dict.fromkeys(("thead", "tbody", "tfoot"), (frozenset(("thead", "tbody", "tfoot")), frozenset(["table"])))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
OTHER_TAGS = frozenset("nav footer aside form menu dialog head button select".split())
OTHER_NAMES = frozenset("ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert nav navbar navigation menu sidebar footer header masthead comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe signup breadcrumb breadcrumbs popup modal overlay widget widgets skip toolbar pagination pager login search".split())
# Words that a name may have besides; a name with any other word, such as related-work, marks nothing.
BESIDE = frozenset("a area articles bar block bottom bottoms box btn button buttons class container content form global group holder icons id inner left link links list main message nav panel posts primary region right row secondary section site slot stories top unit wrap wrapper".split())
MAIN_NAMES = frozenset("article main articlebody".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|math|object|canvas|audio|video|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_MARK = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def host_of(url: str | None) -> str:
    m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", url or "", re.I)
    return m[1].lower() if m else ""


def marks(attributes: str) -> str:
    """The words of a tag's names that can decide a label. A name counts where all its words belong to it."""
    out = set()
    for found in _MARK.findall(attributes):
        for name in "".join(found).split():
            words = [w.lower() for w in _WORD.findall(name)]
            if all(w in OTHER_NAMES or w in BESIDE for w in words):
                out.update(w for w in words if w in OTHER_NAMES)
            out.update(w for w in (*words, name.lower()) if w in MAIN_NAMES)
    return "".join(f".{w}" for w in sorted(out))


def tokens(html: str | None) -> tuple[list[str], list[str]]:
    """Symbols of a page and, for each, its raw text ('' for tags). Slots have the symbol T.

    A tag's symbol is its name with the marks that can decide a label; scripts, styles, comments
    and the like have no symbol. Neighbouring text makes one slot.
    """
    symbols, texts = [], []
    for m in _TOKEN.finditer(html or ""):
        if m["text"] is not None:
            if symbols and symbols[-1] == "T":
                texts[-1] += m["text"]
            elif m["text"].strip():
                symbols.append("T")
                texts.append(m["text"])
        elif m["name"]:
            name = m["name"].lower()
            if name in INLINE:  # text on both its sides is one run
                continue
            symbols.append(f"{m['close']}{name}{'' if m['close'] else marks(m['rest'])}")
            texts.append("")
    return symbols, texts


@dataclass
class Node:
    """A tag or slot (``inner`` None) or a repeated group, and the page tokens it stands for."""

    key: str
    inner: list["Node"] | None
    at: list[int]

    def leaves(self) -> Iterator["Node"]:
        if self.inner is None:
            yield self
        else:
            for x in self.inner:
                yield from x.leaves()


def _absorb(into: list[Node], more: list[Node]) -> None:
    for a, b in zip(into, more):
        if a.inner is None:
            a.at += b.at
        else:
            _absorb(a.inner, b.inner)


def fold(symbols: list[str]) -> list[Node]:
    """The stream with its squares folded into repeated groups, from left to right."""
    out: list[Node] = []
    for i, symbol in enumerate(symbols):
        out.append(Node(symbol, None, [i]))
        again = True
        while again:
            again = False
            n = len(out)
            for size in range(1, min(FOLD, n - 1) + 1):
                group = out[n - size - 1]
                if group.inner is not None and len(group.inner) == size and all(a.key == b.key for a, b in zip(group.inner, out[n - size :])):
                    _absorb(group.inner, out[n - size :])
                    del out[n - size :]
                    again = True
                    break
                if 2 * size <= n and out[n - 1].key == out[n - 1 - size].key and all(out[n - 1 - k].key == out[n - 1 - size - k].key for k in range(1, size)):
                    first = out[n - 2 * size : n - size]
                    _absorb(first, out[n - size :])
                    if size == 1 and first[0].inner is not None:
                        del out[n - 1 :]
                    else:
                        del out[n - 2 * size :]
                        out.append(Node("(" + " ".join(x.key for x in first) + ")+", first, []))
                    again = True
                    break
    return out


def shape(nodes: list[Node]) -> list[str]:
    return [x.key for x in nodes]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    p, q = a[head : len(a) - tail], b[head : len(b) - tail]
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(len(p) - 1, -1, -1):
        for j in range(len(q) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if p[i] == q[j] else max(best[i + 1][j], best[i][j + 1])
    mid, i, j = [], 0, 0
    while i < len(p) and j < len(q):
        if p[i] == q[j]:
            mid.append((head + i, head + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return [(k, k) for k in range(head)] + mid + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]


@dataclass
class Wrapper:
    """Keys in order, which are optional, the pages behind it, and each slot's constant text.

    ``same`` maps a top-level slot's place to a pair: a digest of its whole text (None once two
    pages differ) and the digests of up to ``CONSTANT_PAGES`` different pages that have it.
    """

    keys: list[str]
    optional: list[bool]
    same: dict[int, tuple[str | None, list[str]]]

    def merged(self, other: "Wrapper") -> "Wrapper":
        """The alignment of both: what only one side has becomes optional."""
        keys, optional, same = [], [], {}
        i = j = 0

        def take(w: Wrapper, k: int) -> None:
            if k in w.same:
                same[len(keys)] = w.same[k]
            keys.append(w.keys[k])
            optional.append(True)

        for p, q in [*common(self.keys, other.keys), (len(self.keys), len(other.keys))]:
            while i < p:
                take(self, i)
                i += 1
            while j < q:
                take(other, j)
                j += 1
            if p < len(self.keys):
                a, b = self.same.get(p), other.same.get(q)
                if a and b:
                    same[len(keys)] = (a[0], sorted({*a[1], *b[1]})[:CONSTANT_PAGES]) if a[0] == b[0] and a[0] is not None else (None, [])
                keys.append(self.keys[p])
                optional.append(self.optional[p] or other.optional[q])
                i, j = p + 1, q + 1
        return Wrapper(keys, optional, same)

    def expression(self) -> str:
        """The wrapper as a regular expression over tags and slots."""
        return " ".join(f"({k})?" if o else k for k, o in zip(self.keys, self.optional))

    def dumps(self) -> str:
        return json.dumps([self.keys, self.optional, sorted((k, *v) for k, v in self.same.items())], ensure_ascii=False)

    @staticmethod
    def loads(text: str) -> "Wrapper":
        keys, optional, same = json.loads(text)
        return Wrapper(keys, optional, {k: (t, n) for k, t, n in same})


def digest(*texts: str) -> str:
    """A 128-bit hash and the length of texts with one space between words."""
    data = "\0".join(" ".join(x.split()) for x in texts).encode("utf-8", "surrogatepass")
    return f"{hashlib.blake2b(data, digest_size=16).hexdigest()}{len(data)}"


def page_wrapper(nodes: list[Node], texts: list[str], inside: list[tuple[bool, bool]]) -> Wrapper:
    """The wrapper of one page. Pages that differ in other matter alone, such as adverts, count as one."""
    page = digest(*(t for t, (other, _) in zip(texts, inside) if not other))
    same = {k: (digest(texts[x.at[0]]), [page]) for k, x in enumerate(nodes) if x.key == "T"}
    return Wrapper(shape(nodes), [False] * len(nodes), same)


def contained(symbols: list[str]) -> list[tuple[bool, bool]]:
    """For each symbol, whether it stands in other matter, and whether in an article container.

    Every element is ended by its own closing tag, by that of an element around it, or by a tag that
    ends it in browsers.
    """
    stack: list[tuple[str, bool, bool]] = []
    count: dict[str, int] = {}
    out = []

    def close(names: frozenset[str], until: frozenset[str]) -> None:
        if any(count.get(x) for x in names):
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] in names:
                    for x, *_ in stack[at:]:
                        count[x] -= 1
                    del stack[at:]
                    return
                if stack[at][0] in until:
                    return

    for symbol in symbols:
        name, *marks = symbol.lstrip("/").split(".")
        if symbol.startswith("/"):
            close(frozenset([name]), _LISTS if name == "li" else frozenset())
        elif symbol != "T":
            if stack and stack[-1][0] == "head" and name not in VOID:
                close(frozenset(["head"]), frozenset())
            if name in AFTER_P:
                close(frozenset(["p"]), frozenset(["button", "table", *_CELLS]))
            if name in SIBLINGS:
                close(*SIBLINGS[name])
            if name not in VOID:
                _, around, inside = stack[-1] if stack else ("", False, False)
                main = name in ("article", "main") or bool(MAIN_NAMES & {*marks})
                named = OTHER_NAMES & {*marks} - ({"header"} if inside else set())
                other = name in OTHER_TAGS or (name == "header" and not inside) or (bool(named) and name not in ("body", "html", "article", "main"))
                stack.append((name, around or other, inside or main))
                count[name] = count.get(name, 0) + 1
        out.append(stack[-1][1:] if stack else (False, False))
    return out


def constant(wrapper: Wrapper, keys: list[str]) -> list[int]:
    """Places of a page's shape whose slots have the same text on all pages, on enough different ones."""
    where = dict((b, a) for a, b in common(wrapper.keys, keys))
    found = {k: wrapper.same.get(where[k], (None, [])) for k in where}
    return [k for k, (text, pages) in found.items() if text is not None and len(pages) >= CONSTANT_PAGES]


def page_text(html: str | None, wrapper: Wrapper | None, known: dict) -> str:
    """A page's content, block by block; ``known`` keeps the constant places of each shape of a host."""
    symbols, texts = tokens(html)
    inside = contained(symbols)
    use = [i for i, x in enumerate(symbols) if x == "T" and inside[i] == (False, True)]
    if not use:
        nodes = fold(symbols)
        keys = tuple(shape(nodes))
        if keys not in known:
            known[keys] = constant(wrapper, list(keys)) if wrapper else []
        template = {nodes[k].at[0] for k in known[keys]}
        use = [i for i, x in enumerate(symbols) if x == "T" and inside[i] == (False, False) and i not in template]
    found = (" ".join(entities.unescape(texts[i]).split()) for i in use)
    return " ".join(x for x in found if x)


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's wrapper of each host."""
    hosts: dict[str, dict[tuple[str, ...], Wrapper]] = {}
    for batch in batches:
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            symbols, texts = tokens(html)
            new = page_wrapper(fold(symbols), texts, contained(symbols))
            shapes = hosts.setdefault(host_of(url), {})
            key = tuple(new.keys)
            shapes[key] = shapes[key].merged(new) if key in shapes else new
    rows = []
    for host, shapes in hosts.items():
        rows.append((host, merge_all([shapes[k] for k in sorted(shapes, key=lambda k: (-len(k), k))]).dumps()))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["host", "wrapper"])


def merge_all(wrappers: list[Wrapper]) -> Wrapper:
    out = wrappers[0]
    for x in wrappers[1:]:
        out = out.merged(x)
    return out


def infer(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` (as JSON) of every host of ``pages`` (url, html)."""

    def merge(pdf):
        import pandas as pd

        parts = [Wrapper.loads(x) for x in sorted(pdf["wrapper"], key=lambda x: (-len(x), x))]
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [merge_all(parts).dumps()]})

    return pages.mapInArrow(_infer, "host string, wrapper string").groupBy("host").applyInPandas(merge, "host string, wrapper string")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    wrappers = keep(infer(pages.select("url", "html")), "wrappers")
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    held = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.collect()}) if size <= BROADCAST_BYTES else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, tuple[Wrapper | None, dict]] = {}
        for batch in batches:
            urls = batch.column("url").to_pylist()
            own = batch.column("wrapper").to_pylist() if held is None else None
            out = []
            for i, (url, html) in enumerate(zip(urls, batch.column("html").to_pylist())):
                host = host_of(url)
                if host not in loaded:
                    text = own[i] if held is None else held.value.get(host)
                    loaded[host] = (Wrapper.loads(text) if text else None, {})
                out.append(page_text(html, *loaded[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if held is None:
        named = pages.mapInArrow(_hosted, "page_id long, url string, html string, host string")
        pages = named.join(wrappers, "host", "left")
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def _hosted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts = [host_of(x) for x in batch.column("url").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hosts, pa.string())], names=[*batch.schema.names, "host"])
