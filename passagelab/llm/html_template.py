"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from templates. A token is a tag or a block of text together with the path of the elements
that it stands in. Tokens with the same occurrence vector (how often each appears on each page of the host)
form an equivalence class; classes on enough pages with enough tokens are the host's templates. A vector is held as
a commutative sum of hashes of (page, count), so hosts of any size aggregate map-side, and no vector is ever
gathered. Classes whose places cross are not valid; the others are nested by their places into a template.

The template's tokens divide a page into slots. What stands in a slot on the host's pages, less the template's own texts, is the slot's
mass. On each page the template's elements are followed inwards, from class to nested class, as long as one of them holds at least half of the mass: this is the
main slot, and its text, with a headline above it and without the template's own texts, is the main text. Names of tags and classes only break ties, take
adverts, comments and the like out of the main slot, and serve for hosts with too few pages for a template.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelab.llm.common import BROADCAST_BYTES, forget, map_batches, ship, small, written

# HTML's elements by their kind, and names by which sites mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe select object".split())
ENDS_WITH_PAGE = frozenset("script style textarea title iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SELF_ENDING = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "td": "td th", "th": "td th", "tr": "tr td th", "option": "option"}
BARS = frozenset("ul ol dl table article section div main body nav aside footer header form".split())
NOT_MAIN = frozenset("nav footer aside form button head dialog menu".split())
NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
NOT_MAIN_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME = re.compile(r"[a-z]+")
#: Numbers that differ from page to page: any in an id, long ones in a class.
NUMBER, LONG_NUMBER = re.compile(r"[0-9]+"), re.compile(r"[0-9]{3,}")


class Block:
    """A block of text: `path` and `chain` (hashes) of the elements around it, whether those are an article, and the place in the chain of the innermost that by its name is none of it."""

    __slots__ = ("text", "path", "chain", "article", "other")

    def __init__(self, text: str, path: str, chain: tuple[int, ...], article: bool, other: int | None):
        self.text, self.path, self.chain, self.article, self.other = text, path, chain, article, other


class Element:
    """An open element. token: its place among the page's tokens; chars: of the text in it so far."""

    __slots__ = ("name", "path", "chain", "article", "other", "token", "chars")

    def __init__(self, name: str, path: str, chain: tuple[int, ...], article: bool, other: int | None, token: int):
        self.name, self.path, self.chain, self.article, self.other, self.token, self.chars = name, path, chain, article, other, token, 0


OUTSIDE = Element("", "", (), False, None, -1)
#: What a page's token is: a block of text, an element that has content, another tag.
TEXT, ELEMENT, TAG_ONLY = range(3)


def _traits(name: str, attributes: str) -> tuple[str, bool]:
    """(label with class and id, whether the element by itself is not of the article)."""
    if not attributes.strip():
        return name, name in NOT_MAIN
    found = {}
    for key, value in ATTRIBUTE.findall(attributes):
        found.setdefault(key.lower(), value.strip("\"'"))
    label = name + "".join(f"{mark}{numbers.sub('0', found[key])}" for mark, key, numbers in ((".", "class", LONG_NUMBER), ("#", "id", NUMBER)) if found.get(key))
    names = NAME.findall(f"{found.get('class', '')} {found.get('id', '')}".lower())
    other = name in NOT_MAIN or "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in NOT_MAIN_ROLES
    if name not in ("html", "body", "main"):
        other = other or not NOT_MAIN_NAMES.isdisjoint(names)
    return label, other


def parse(page: str | None) -> tuple[list[list], list[Block]]:
    """(tokens, blocks) of a page. Tokens are [path, tag or text, kind, hash of the element around, chars in it]; unclosed elements end where HTML ends them, at the latest with an outer one."""
    page = page or ""
    tokens: list[list] = []
    blocks: list[Block] = []
    stack: list[Element] = []
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                at = stack[-1] if stack else OUTSIDE
                at.chars += len(text)
                blocks.append(Block(text, at.path, at.chain, at.article, at.other))
                tokens.append([at.path, text, TEXT, at.chain[-1] if at.chain else 0, len(text)])

    def close(k: int) -> None:
        flush()
        while len(stack) > k:
            ended = stack.pop()
            tokens[ended.token][4] = ended.chars
            if stack:
                stack[-1].chars += ended.chars

    def tag_only(token: str) -> None:
        at = stack[-1] if stack else OUTSIDE
        tokens.append([at.path, token, TAG_ONLY, at.chain[-1] if at.chain else 0, 0])

    def raw_text(name: str, at: int) -> int:
        end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
        return end.end() if end else len(page) if name in ENDS_WITH_PAGE else at

    at = 0
    while at < len(page):
        mark = page.find("<", at)
        if mark < 0:
            buffer.append(page[at:])
            break
        if mark > at:
            buffer.append(page[at:mark])
        tag = TAG.match(page, mark)
        if not tag:
            if page[mark + 1 : mark + 2].isalpha() or page[mark + 1 : mark + 2] == "/":  # a quote is not closed, or a stray end
                end = page.find(">", mark)
                at = len(page) if end < 0 else end + 1
            else:
                buffer.append("<")
                at = mark + 1
            continue
        at = tag.end()
        if tag[2] is None:
            continue  # a comment or a declaration
        name = tag[2].lower()
        if tag[1]:  # an end tag
            if name in INLINE or name in RAW:
                continue
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name), None)
            if k is None:
                if name == "p":
                    flush()
                continue
            close(k)
            tag_only(f"</{name}>")
            continue
        if name in RAW:
            at = raw_text(name, at)
            tag_only(f"<{name}>")
            continue
        if name in INLINE:
            if tag[3] and stack and _traits(name, tag[3])[1]:  # an inline element of an advert or the like
                at = _after(page, at, name)
            continue
        flush()
        if name in VOID:
            tag_only(f"<{name}>")
            continue
        ended = SELF_ENDING.get(name, "").split()
        if not ended and name not in INLINE:
            ended = ["p"]
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].name in ended:
                close(k)
                break
            if stack[k].name in BARS:
                break
        label, other = _traits(name, tag[3])
        above = stack[-1] if stack else OUTSIDE
        if name == "header":
            other = other or not above.article  # a header in an article has its title
        elif name in ("article", "main") and not above.article:
            other = False
        empty = tag[3].rstrip().endswith("/") and name not in ("p", "div", "article", "section", "main", "body", "html")
        tokens.append([above.path, f"<{label}>", TAG_ONLY if empty else ELEMENT, above.chain[-1] if above.chain else 0, 0])
        if not empty:
            chain = (*above.chain, token_hash(above.path, f"<{label}>"))
            stack.append(Element(name, f"{above.path}/{label}", chain, above.article or name in ("article", "main"), len(above.chain) if other else above.other, len(tokens) - 1))
    close(0)
    OUTSIDE.chars = 0
    return tokens, blocks


def _after(page: str, at: int, name: str) -> int:
    """The place after the end of an inline element that began before `at`, whatever elements of its name it holds; without an end tag, `at`."""
    depth = 1
    for tag in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        depth += -1 if tag[1] else 1
        if not depth:
            return tag.end()
    return at


class Template:
    """What a host's nested classes say of a page: the once-a-page elements with their class and mass, the class above each, and the class of each fixed text."""

    def __init__(self, classes: list[dict]):
        self.up = {c["class"]: c["parent"] for c in classes}
        self.elements = {e["token"]: (c["class"], e["mass"]) for c in classes for e in c["elements"]}
        self.texts = {t: c["class"] for c in classes for t in c["texts"]}

    def within(self, inner: int, outer: int) -> bool:
        """Whether a class is the outer one or nested in it."""
        while inner != outer and inner >= 0:
            inner = self.up.get(inner, -1)
        return inner == outer

    def main_slot(self, blocks: list[Block]) -> tuple[list[Block], int, float]:
        """(blocks, depth, mass) of the page's main slot: its blocks, the number of elements around it, and the mass that it has by the host's pages."""
        depth, mass, own = 0, 0.0, None
        while True:
            inner: dict[int, list[Block]] = {}
            for b in blocks:
                if len(b.chain) > depth and (known := self.elements.get(b.chain[depth])) and (own is None or self.within(known[0], own)):
                    inner.setdefault(b.chain[depth], []).append(b)
            if not inner:
                return blocks, depth, mass
            best = max(inner, key=lambda e: (self.elements[e][1], -e))
            most = self.elements[best][1]
            total = max(mass, sum(self.elements[e][1] for e in inner))
            named = sum(self.elements[e][1] for e, held in inner.items() if e != best and all(b.other is not None and b.other >= depth for b in held))
            if not most or 2 * most < total and 2 * most < total - named:
                return blocks, depth, mass
            blocks, depth, mass, own = inner[best], depth + 1, most, self.elements[best][0]


def main_text(page: str | None, template: Template | None = None) -> str:
    """The blocks of the main slot joined by one space.

    Without a template, or where it has no slot with a mass, the article's blocks by the names of tags and classes; a page without an article gives the blocks of the
    body that are nothing else, and of these those that are not the template's own, if there are others.
    """
    blocks = parse(page)[1]
    slot, depth, mass = template.main_slot(blocks) if template else (blocks, 0, 0.0)
    if not mass:
        named = [b for b in blocks if b.other is None]
        inside = [b for b in named if b.article]
        if not inside:
            inside = [b for b in named if not template or token_hash(b.path, b.text) not in template.texts] or named
        return " ".join(b.text for b in inside)
    around = slot[0].chain[:depth]
    own = template.elements[around[-1]][0]
    headline = not any("/h1" in b.path[len(b.path) // 2 :] for b in slot)
    held = set(map(id, slot))
    out = []
    for b in blocks:
        if id(b) in held:
            if (b.other is None or b.other < depth) and template.texts.get(token_hash(b.path, b.text)) != own:
                out.append(b.text)
        elif headline and b.path.endswith("/h1"):
            shared = next((k for k, (x, y) in enumerate(zip(b.chain, around)) if x != y), min(len(b.chain), depth))
            if shared and (b.other is None or b.other < shared):
                out.append(b.text)
    return " ".join(out)


def token_hash(path: str, token: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{path}\0{token}".encode("utf-8", "surrogatepass")) - (1 << 63)


def host_of(url):
    """The host of a URL column in lower case; empty if it has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


TOKENS = "host string, token long, kind int, vector long, pages long, total long, first double, last double, around long, chars long"
TOKEN_NAMES = [x.split()[0] for x in TOKENS.split(", ")]


def token_counts(pages: DataFrame) -> DataFrame:
    """(host, token, kind, vector, pages, total, first, last, around, chars) for each host: sums over its pages, made in the tasks first.

    vector: a sum modulo 2^64 of hashes of (page, count). first and last: means of relative places on the page. around: the element that the token
    stands in; chars: of the text in it. pages: (page long, host, html).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: dict[tuple[str, int], list] = {}
        for batch in batches:
            for page, host, body in zip(batch.column("page").to_pylist(), batch.column("host").to_pylist(), batch.column("html")):
                tokens = parse(body.as_py())[0]
                n = max(1, len(tokens) - 1)
                met: dict[int, list] = {}
                for k, (path, token, kind, around, chars) in enumerate(tokens):
                    own = met.setdefault(token_hash(path, token), [kind, 0, k, k, around, 0])
                    own[1] += 1
                    own[3] = k
                    own[5] += chars
                for h, (kind, count, first, last, around, chars) in met.items():
                    sums = held.setdefault((host, h), [kind, 0, 0, 0, 0.0, 0.0, around, 0])
                    sums[1] = (sums[1] + xxhash.xxh3_64_intdigest(f"{page}:{count}")) & 0xFFFFFFFFFFFFFFFF
                    sums[2] += 1
                    sums[3] += count
                    sums[4] += first / n
                    sums[5] += last / n
                    sums[7] += chars
            if len(held) > 200_000:
                yield _sums(held)
                held = {}
        if held:
            yield _sums(held)

    counted = map_batches(pages.select("page", "host", "html"), run, TOKENS)
    sums = [F.sum(c).alias(c) for c in ("pages", "total", "first", "last", "chars")]
    grouped = counted.groupBy("host", "token", "kind", "around").agg(F.expr("sum(cast(vector as decimal(38,0)))").alias("v"), *sums)
    return grouped.select("host", "token", "kind", F.expr("pmod(v, 18446744073709551616BD)").alias("vector"), "pages", "total", (F.col("first") / F.col("pages")).alias("first"), (F.col("last") / F.col("pages")).alias("last"), "around", "chars")


def _sums(held: dict) -> pa.RecordBatch:
    hosts, tokens = zip(*held)
    kind, vector, pages, total, first, last, around, chars = zip(*held.values())
    signed = [v - (1 << 64) if v >> 63 else v for v in vector]
    columns = [pa.array(hosts, pa.string()), pa.array(tokens, pa.int64()), pa.array(kind, pa.int32()), *(pa.array(c, pa.int64()) for c in (signed, pages, total)), pa.array(first, pa.float64()), pa.array(last, pa.float64()), pa.array(around, pa.int64()), pa.array(chars, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, TOKEN_NAMES)


TEMPLATE = "host string, parent int, class int, elements array<struct<token: long, mass: double>>, texts array<long>, pages long"


def nested(classes: pd.DataFrame) -> pd.DataFrame:
    """A host's classes (one row for each token) to its template: each valid class with the class that holds it, -1 for the outermost.

    elements: those that stand once on each of their pages, with their mass: the characters that a page has in them on average, without the template's texts.
    """
    spans = []
    for _, own in classes.groupby(["vector", "pages", "total"], sort=True):
        spans.append((own["first"].min(), own["last"].max(), own.sort_values(["first", "token"])))
    spans.sort(key=lambda s: (s[0], -s[1], -len(s[2]), int(s[2]["token"].iloc[0])))
    valid: list[tuple] = []
    open_classes: list[int] = []
    for first, last, own in spans:
        while open_classes and valid[open_classes[-1]][1] < first:
            open_classes.pop()
        if open_classes and last > valid[open_classes[-1]][1] + 1e-9 and (own["kind"] != TEXT).all():
            continue  # it crosses the class in which it begins
        valid.append((first, last, own, open_classes[-1] if open_classes else -1))
        open_classes.append(len(valid) - 1)
    is_element = classes["kind"] == ELEMENT
    around = dict(zip(classes.loc[is_element, "token"].tolist(), classes.loc[is_element, "around"].tolist()))
    mass = dict(zip(classes.loc[is_element, "token"].tolist(), classes.loc[is_element, "chars"].tolist()))
    fixed = pd.concat([own[own["kind"] == TEXT] for _, _, own, _ in valid]) if valid else classes[:0]
    for element, chars in zip(fixed["around"].tolist(), fixed["chars"].tolist()):
        met = set()
        while element in mass and element not in met:
            met.add(element)
            mass[element] -= chars
            element = around[element]
    host = classes["host"].iloc[0]
    rows = []
    for k, (_, _, own, up) in enumerate(valid):
        once = own[(own["kind"] == ELEMENT) & (own["total"] == own["pages"])]
        elements = [{"token": t, "mass": max(0, mass[t]) / n} for t, n in zip(once["token"].tolist(), once["pages"].tolist())]
        rows.append((host, up, k, elements, own.loc[own["kind"] == TEXT, "token"].tolist(), int(own["pages"].iloc[0])))
    return pd.DataFrame(rows, columns=["host", "parent", "class", "elements", "texts", "pages"])


def templates(pages: DataFrame, least_pages: int = 4, least_share: float = 0.3, least_tokens: int = 2) -> DataFrame:
    """The nested classes of each host. A class has tokens on at least `least_pages` pages and `least_share` of the host's, and
    `least_tokens` members or one that is text. The tokens of one host that pass are bounded by the pages' length."""
    counts = written(token_counts(pages), "tokens")
    hosts = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    frequent = counts.join(small(hosts, hosts.count()), "host").where((F.col("pages") >= least_pages) & (F.col("pages") >= least_share * F.col("host_pages")))
    sizes = frequent.groupBy("host", "vector", "pages", "total").agg(F.count("*").alias("members"), F.min("kind").alias("least"))
    fit = sizes.where((F.col("members") >= least_tokens) | (F.col("least") == TEXT)).select("host", "vector", "pages", "total")
    members = frequent.join(fit, ["host", "vector", "pages", "total"]).select("host", F.col("vector").cast("string").alias("vector"), "pages", "total", "token", "kind", "first", "last", "around", "chars")
    out = written(members.groupBy("host").applyInPandas(nested, TEMPLATE), "templates")
    forget(counts)
    return out


CLASS = "array<struct<class: int, parent: int, elements: array<struct<token: long, mass: double>>, texts: array<long>>>"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text) of each row.

    Null and empty pages, and pages of nothing but boilerplate, have an empty text. Rows that repeat an id or a page, and
    rows without a URL (their host is empty), are pages like any other. Very long pages are read whole. Other
    columns are ignored; an empty table gives no rows. Templates beyond `most_bytes` are joined by a shuffle, with the same result.
    """
    keyed = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    keyed = keyed.withColumn("host", host_of(F.col("url")))
    ship(pages.sparkSession)
    found = templates(keyed.select(F.xxhash64("page_id", "url").alias("page"), "host", "html"))
    shapes = written(found.groupBy("host").agg(F.collect_list(F.struct("class", "parent", "elements", "texts")).cast(CLASS).alias("classes")), "shapes")  # of one site's template
    forget(found)
    size = shapes.agg(F.coalesce(F.sum(F.expr("64L + aggregate(classes, 0L, (n, c) -> n + 64 + 32 * size(c.elements) + 8 * size(c.texts))")), F.lit(0))).first()[0]
    if size <= most_bytes:
        joined = keyed.join(F.broadcast(shapes), "host", "left")
    else:  # pages of a large host are dealt over many tasks
        salts = 64
        dealt = shapes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(dealt, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, Template | None] = {}
            out = []
            for host, body, classes in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("classes")):
                if host not in known:
                    known[host] = Template(classes.as_py()) if classes.is_valid else None
                out.append(main_text(body.as_py(), known[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return map_batches(joined.select("page_id", "url", "host", "html", "classes"), run, "page_id long, url string, text string")


def report(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
