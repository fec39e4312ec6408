"""HTML main text by wrappers: union-free regular expressions inferred for each host.

A page becomes a stream of tokens, one for each block of text: the path of its
open elements, marked if the block is link text only.  Three passes:

1. Texts that a host repeats are template: a text at a path that stands beside
   LEAST different main blocks and on SHARE of them.  Such a text is a token of
   its own; any other is a text slot of its path.
2. Repeats in a stream fold into groups, so pages of one template fold into a few
   forms.  The forms of a host are aligned one by one: equal tokens match, tokens
   on one side only become optional, repeats on either side stay repeats.  The
   result is the host's wrapper, which accepts every page of the host.
3. Each page is matched against the wrapper.  Its slots are labelled: boilerplate
   by the elements they stand under, menus where link text is repeated in the
   wrapper, template texts, and main text for the rest.  A page with an article
   has the slots under it as its text, whatever is constant there.

Only distinct forms reach the task of a host, never its pages, and texts of
pages with an article, which is told from the page alone, aren't counted.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of wrappers up to which they are measured small enough to broadcast; beyond, a shuffle join.
BROADCAST_BYTES = 8 << 20
#: A repeated text is template beside so many different main blocks of a host, and so large a share of them.
LEAST, SHARE = 3, 0.3
#: Tokens of the longest group that folds, and the mark of link text.
GROUP, LINK = 4, "@"


#: Fixed values of HTML: tags without content, tags whose content is no markup, tags inside a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn del em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())
#: Tags that hold boilerplate, tags that hold the article, and words in class or id that mark boilerplate.
BOILER = frozenset("nav footer aside form button select option label input dialog menu head script style noscript template textarea title iframe svg".split())
MAIN = frozenset("article main".split())
MARKED = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice notices alert sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer comment comments reply replies respond share social related newsletter subscribe popup modal widget".split())
#: Elements that end when one of these opens, as HTML lets their end tags go.
CLOSES = {"p": frozenset("p div article section ul ol table h1 h2 h3 h4 h5 h6 blockquote pre form nav footer header aside main hr dl".split()), "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


def _label(tag: str, attrs: str) -> str:
    """The token of an element: its tag, with a mark if it is one of boilerplate, and its classes."""
    words: set[str] = set()
    if attrs:
        for key, a, b, c in ATTR.findall(attrs):
            words.update([key.lower()] if key.lower() == "hidden" else re.findall(r"[a-z]+", (a or b or c).lower()))
    return tag + ("!" if tag not in MAIN and tag != "body" and (words & MARKED or "hidden" in words) else "")


def tokens_of(page: str) -> list[tuple[str, str]]:
    """(kind, value): ``<`` element opens, ``>`` element closes, ``#`` raw text run, ``|`` a break in a block."""
    out: list[tuple[str, str]] = []
    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            break
        if m.start() > at:
            out.append(("#", page[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            out.append((">", tag))
        elif tag in VOID:
            out.append(("|", tag))
        else:
            out.append(("<", _label(tag, m[3])))
            if tag in RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                out.append((">", tag))
                at = end.end() if end else size
    if at < size:
        out.append(("#", page[at:]))
    return out


def blocks_of(page: str) -> list[tuple[str, str, bool]]:
    """(path of the open elements, text, whether all of it is link text) of each block, in page order.

    A path joins the elements from the outside in; inline elements are no part of it.  Text around
    inline elements is one block; character references are decoded, white space becomes one space.
    """
    out: list[tuple[str, str, bool]] = []
    stack: list[str] = []
    held: list[str] = []
    place, links, plain = "", 0, False

    def flush() -> None:
        nonlocal plain
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append((place, text, not plain))
        held.clear()
        plain = False

    for kind, value in tokens_of(page):
        if kind == "#":
            held.append(value)
            plain = plain or (not links and not value.isspace())
            continue
        tag = value.rstrip("!")
        if kind == "|":
            if tag not in INLINE:
                held.append(" ")
            continue
        if tag in INLINE and not value.endswith("!"):
            if tag == "a":
                links = max(0, links + (1 if kind == "<" else -1))
            continue
        flush()
        if kind == "<":
            while stack and tag in CLOSES.get(stack[-1].rstrip("!"), ()):
                stack.pop()
            stack.append(value)
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].rstrip("!") == tag:
                    del stack[k:]
                    break
        place = "/".join(stack)
    flush()
    return out


# --------------------------------------------------------------- wrappers

#: A wrapper or a form is a list of (tokens of a group, repeated, optional).
Element = tuple[tuple[str, ...], bool, bool]


def _plain(part: list[Element]) -> tuple[str, ...] | None:
    """The tokens of single, unrepeated and not optional elements."""
    return None if any(len(g) > 1 or r or o for g, r, o in part) else tuple(g[0] for g, _, _ in part)


def fold(tokens: list[str]) -> list[Element]:
    """Groups of up to GROUP tokens that follow themselves become one repeated element."""
    out: list[Element] = []
    for t in tokens:
        out.append(((t,), False, False))
        k = 1
        while k <= GROUP:
            group = _plain(out[-k:]) if len(out) > k else None
            if group and out[-k - 1][1] and out[-k - 1][0] == group:
                del out[-k:]
            elif group and len(out) >= 2 * k and _plain(out[-2 * k : -k]) == group:
                out[-2 * k :] = [(group, True, False)]
            else:
                k += 1
                continue
            k = 1
    return out


def _collapse(form: list[Element], groups: set[tuple[str, ...]]) -> list[Element]:
    """Runs of single elements that are a group of the other side become one element."""
    out: list[Element] = []
    i = 0
    while i < len(form):
        for k in range(min(GROUP, len(form) - i), 1, -1):
            if (part := _plain(form[i : i + k])) in groups:
                out.append((part, False, False))
                i += k
                break
        else:
            out.append(form[i])
            i += 1
    return out


def align(wrapper: list[Element], form: list[Element]) -> list[Element]:
    """The wrapper that also takes the form: equal elements match, others become optional, repeats on either side stay repeats."""
    a = _collapse(wrapper, {g for g, _, _ in form if len(g) > 1})
    b = _collapse(form, {g for g, _, _ in wrapper if len(g) > 1})
    out: list[Element] = []
    for op, i, j, k, m in SequenceMatcher(None, [g for g, _, _ in a], [g for g, _, _ in b], autojunk=False).get_opcodes():
        if op == "equal":
            out += [(x[0], x[1] or y[1], x[2] or y[2]) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [(g, r, True) for g, r, _ in (*a[i:j], *b[k:m])]
    return out


def infer_wrapper(forms: list[list[Element]]) -> list[Element]:
    """The wrapper of a host's forms, aligned from the longest down."""
    forms = sorted(forms, key=lambda f: (-len(f), f))
    wrapper = forms[0] if forms else []
    for f in forms[1:]:
        wrapper = align(wrapper, f)
    return wrapper


def wrapper_pattern(wrapper: list[Element]) -> str:
    """The wrapper as a regular expression over tokens, each ended by a line break."""
    mark = {(False, False): "", (True, False): "+", (False, True): "?", (True, True): "*"}
    return "".join(f"(?:{''.join(re.escape(t) + chr(92) + 'n' for t in g)}){mark[r, o]}" for g, r, o in wrapper)


def menus_of(wrapper: list[Element]) -> list[str]:
    """Slots of link text that the wrapper repeats."""
    return sorted({t for g, r, _ in wrapper if r for t in g if t.endswith(LINK)})


# ------------------------------------------------------------------- slots


def is_clean(path: str) -> bool:
    """Whether no element of a path is boilerplate; a header inside the article is none."""
    inside = False
    for x in path.split("/"):
        if x.endswith("!") or x in BOILER or (x == "header" and not inside):
            return False
        inside |= x in MAIN
    return True


def in_article(path: str) -> bool:
    return not MAIN.isdisjoint(path.split("/"))


def _key(path: str, text: str) -> int:
    data = np.frombuffer(f"{path}\n{text}".encode("utf-8", "surrogatepass"), np.uint8)
    return int(C.hash_spans(data, np.array([0]), np.array([len(data)])).view(np.int64)[0])


def open_blocks(blocks: list[tuple[str, str, bool]]) -> list[tuple[str, str, bool]]:
    """Blocks whose label the page alone can't tell: clean ones of a page without an article's."""
    clean = [b for b in blocks if is_clean(b[0])]
    return [] if any(in_article(p) for p, _, _ in clean) else clean


def evidence_of(blocks: list[tuple[str, str, bool]]) -> tuple[list[int], int]:
    """(keys of a page's open texts, key of its longest one, which stands for its content); without open texts none."""
    some = open_blocks(blocks)
    if not some:
        return [], 0
    longest = max(some, key=lambda b: (len(b[1]), b[1]))
    return sorted({_key(p, t) for p, t, _ in some}), _key("", longest[1])


def tokens_for(blocks: list[tuple[str, str, bool]], templates: set[int]) -> list[str]:
    """The token of each block: its path, marked for link text, or the path and the key of a template text."""
    some = {id(b) for b in open_blocks(blocks)} if templates else set()
    return [f"{b[0]}={k:x}" if id(b) in some and (k := _key(b[0], b[1])) in templates else b[0] + (LINK if b[2] else "") for b in blocks]


def main_text(blocks: list[tuple[str, str, bool]], menus: set[str], templates: set[int]) -> str:
    """Text of a page's main slots: those of its article, or else all that are no boilerplate, menu or template."""
    clean = [(p, t) for p, t, _ in blocks if is_clean(p)]
    held = [t for p, t in clean if in_article(p)]
    if held:
        return " ".join(held)
    return " ".join(b[1] for b, x in zip(blocks, tokens_for(blocks, templates), strict=True) if is_clean(b[0]) and x not in menus and "=" not in x[len(b[0]) :])


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1))


def infer_templates(pages: DataFrame) -> DataFrame:
    """host, templates (keys of repeated texts).  At most 1 / SHARE times the blocks of a page are kept for a host."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, content = evidence_of(blocks_of(page or ""))
                # content as a key of its own counts a host's pages
                rows.update((host, k, content) for k in (*keys, 0) if content)
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["host", "key", "content"])

    seen = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(read, "host string, key long, content long").distinct()
    counts = seen.groupBy("host", "key").agg(F.count("*").alias("n"))
    counts = C.Scratch(pages.sparkSession).save(counts.where((F.col("n") >= LEAST) | (F.col("key") == 0)))
    total = counts.where("key = 0").select("host", F.col("n").alias("total"))
    often = counts.where(f"key <> 0 and n >= {LEAST}").join(total, "host").where(F.col("n") >= SHARE * F.col("total"))
    return often.groupBy("host").agg(F.sort_array(F.collect_set("key")).alias("templates"))


def _with_table(pages: DataFrame, table: DataFrame, size: int) -> DataFrame:
    return pages.join(F.broadcast(table) if size <= BROADCAST_BYTES else table, "host", "left")


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (as JSON), menus (repeated slots of link text), templates (keys of repeated texts)."""
    scratch = C.Scratch(pages.sparkSession)
    templates = scratch.save(infer_templates(pages))
    size = templates.agg(F.sum(F.length("host") + 8 * F.size("templates") + 64)).first()[0] or 0
    known = _with_table(pages.select(host_of(F.col("url")).alias("host"), "html"), templates, size).select("host", "html", "templates")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            seen = sorted({(h, json.dumps([[g, r] for g, r, _ in fold(tokens_for(blocks_of(x or ""), set(t or ())))])) for h, x, t in rows})
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.string()), pa.array([f for _, f in seen], pa.string())], names=["host", "form"])

    def infer(frame: pd.DataFrame) -> pd.DataFrame:
        wrapper = infer_wrapper([[(tuple(g), r, False) for g, r in json.loads(f)] for f in frame["form"]])
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [json.dumps(wrapper)], "menus": [menus_of(wrapper)]})

    forms = known.mapInArrow(read, "host string, form string").groupBy("host", "form").agg(F.lit(1).alias("one")).select("host", "form")
    wrappers = forms.groupBy("host").applyInPandas(infer, "host string, wrapper string, menus array<string>")
    return wrappers.join(templates, "host", "left")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    A null page is empty and gives an empty text, as does a page without main
    slots; pages without a host share the empty host.  Very long pages are read
    whole; repeated rows are extracted each and count as one page of their host;
    extra columns are ignored; an empty table gives none.
    """
    pages = pages.select("page_id", "url", "html")
    wrappers = C.Scratch(pages.sparkSession).save(infer_wrappers(pages)).select("host", "menus", "templates")
    size = wrappers.agg(F.sum(F.length("host") + F.length(F.concat_ws("", "menus")) + 8 * F.size(F.coalesce("templates", F.array().cast("array<long>"))) + 64)).first()[0] or 0
    joined = _with_table(pages.withColumn("host", host_of(F.col("url"))), wrappers, size).select("page_id", "url", "html", "menus", "templates")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(blocks_of(page or ""), set(m or ()), set(t or ())) for page, m, t in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(read, "page_id long, url string, text string, n_chars long")
