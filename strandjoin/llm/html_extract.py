"""Main text of pages by template deduction over the pages of a host.

A page is a sequence of element tokens, each with its path (tags with their classes). For every
host and token Spark sums, over all pages of the host, occurrences times a hash of the page:
tokens whose occurrence vectors agree have equal sums, and form an equivalence class. The class
of the tokens that occur once in (nearly) every page is the template's outermost; a class is
valid if its tokens nest (each one's path extends another's, or they share the parent), and
classes nest in the class of their nearest ancestor. The text between template tokens are its
slots. The main slot is found by walking down the outermost class as long as one element holds
all of the text that is no menu, header, footer, sidebar, notice, advert, form or comment; its
slots are extracted, without such parts.

Text blocks are tokens too: their path and a hash of their text. Those of valid classes that
nearly every page has are template, and are taken out wherever they stand; not so on hosts of
fewer than TEMPLATE_PAGES pages, or where they would be most of the text, as on a host of copies,
and a page of such text alone keeps it. The lists of class names are the fallback: on a host with
enough pages they do not decide inside the main slot.

A host's pages never meet in one task: sums are taken per task first, and the deduction sees
only the tokens that at least half of the host's pages have.

Defined results: null html is empty and has the empty text; a null url has the empty host;
repeated rows get a row each; unclosed elements end with their parent, unclosed scripts and
comments with the page. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandjoin.llm.common import stage
from strandjoin.llm.url_filter import host

#: Fixed values of HTML: elements without content, elements whose content is no text, and
#: elements that do not break a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|template|iframe|svg|math|canvas|object|select|option"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
BOILERPLATE = frozenset("nav header footer aside form head menu dialog button fieldset".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb "
    "breadcrumbs header masthead footer sidebar aside widget related share social cookie cookies consent notice "
    "popup modal newsletter subscribe signup login comment comments respond reply replies disqus pagination".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(svg|math)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*/>"
    rf"|<({RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\2\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
#: Fewer pages do not tell template text from text that pages share by chance.
TEMPLATE_PAGES = 5
#: Why an element is boilerplate: by its class or id only, or by its tag or role.
BY_NAME, BY_TAG = 1, 2
#: Hosts up to this number have their slots broadcast; more are joined by shuffle.
BROADCAST_HOSTS = 20_000


def element(tag: str, attributes: str) -> tuple[str, int]:
    """The element's name in paths, and whether it is boilerplate: 0, BY_NAME or BY_TAG."""
    name, boilerplate = tag, BY_TAG * (tag in BOILERPLATE)
    if attributes:
        for key, *values in ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "")
            words = re.findall("[a-z0-9]+", value.lower())
            if key.lower() == "role":
                boilerplate = max(boilerplate, BY_TAG * (value.lower() in ROLES))
                continue
            boilerplate = max(boilerplate, BY_NAME * (not BOILERPLATE_WORDS.isdisjoint(words)))
            if key.lower() == "class":
                name += "." + ".".join(re.sub("[0-9]+", "0", w) for w in words)
    return name, boilerplate


def block_token(path: str, text: str) -> str:
    """The token of a text block: below its element's path, where no element's name begins so."""
    return f"{path}/#{hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}"


def blocks(page: str) -> Iterator[tuple[str, str, int]]:
    """(path, text, boilerplate) of every block, and (path, "", boilerplate) of every element."""
    open_tags: list[tuple[str, str, int]] = []
    held: list[str] = []
    path, boilerplate = "", 0

    def flush() -> list[tuple[str, str, int]]:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        return [(path, text, boilerplate)] if text else []

    for found in TOKEN.finditer(page):
        empty, raw, close, tag, attributes = found.groups()
        token = found.group()
        if tag is None:
            if empty is None and raw is None and not token.startswith(("<!", "<?")):
                held.append(token)
            continue
        tag = tag.lower()
        if tag in INLINE:
            continue
        yield from flush()
        if tag in VOID:
            continue
        if close:
            at = next((k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == tag), None)
            if at is not None:
                del open_tags[at:]
        else:
            # A paragraph or list item ends where the next block starts.
            while open_tags and (open_tags[-1][0] == "p" or open_tags[-1][0] == tag == "li"):
                open_tags.pop()
            name, own = element(tag, attributes)
            above, inside = (open_tags[-1][1], open_tags[-1][2]) if open_tags else ("", 0)
            open_tags.append((tag, f"{above}/{name}", max(inside, own)))
            yield open_tags[-1][1], "", open_tags[-1][2]
        path, boilerplate = (open_tags[-1][1], open_tags[-1][2]) if open_tags else ("", 0)
    yield from flush()


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, path, pages, once, vector, chars): sums of the tokens' occurrences by host and path.

    vector: of occurrences times a hash of the page; once: pages where it occurs once; chars: of
    text below it that is no boilerplate. One row for each batch, host and path, or text block.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], list[int]] = {}
            for name, page, number in zip(*(batch.column(k).to_pylist() for k in range(3))):
                counts: dict[str, int] = {"": 1}
                chars: dict[str, int] = {}
                for path, text, boilerplate in blocks(page or ""):
                    if not text:
                        if not boilerplate:
                            counts[path] = counts.get(path, 0) + 1
                        continue
                    if boilerplate < BY_TAG:
                        token = block_token(path, text)
                        counts[token] = counts.get(token, 0) + 1
                    if boilerplate == 0:
                        chars[token] = chars.get(token, 0) + len(text)
                below = dict.fromkeys(counts, 0)
                for path, n in chars.items():
                    while True:
                        if path in below:
                            below[path] += n
                        if not path:
                            break
                        path = path.rpartition("/")[0]
                for path, n in counts.items():
                    one = sums.setdefault((name, path), [0, 0, 0, 0])
                    one[0] += 1
                    one[1] += n == 1
                    one[2] = (one[2] + n * number) & 0x3FFFFFFFFFFFFFFF
                    one[3] += below[path]
            keys = list(sums)
            columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(2)]
            columns += [pa.array([sums[k][i] for k in keys], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "pages", "once", "vector", "chars"])

    schema = "host string, path string, pages long, once long, vector long, chars long"
    return pages.select("host", "html", "number").mapInArrow(scan, schema)


def token_classes(pages: DataFrame) -> DataFrame:
    """Per host and token: its sums, and its equivalence class (vector) among frequent tokens."""
    wide = F.sum(F.col("vector").cast("decimal(38,0)"))
    tokens = occurrences(pages).groupBy("host", "path").agg(
        F.sum("pages").alias("pages"), F.sum("once").alias("once"), wide.alias("vector"), F.sum("chars").alias("chars")
    )
    # Rarer text blocks cannot be template.
    tokens = tokens.where(~F.contains("path", F.lit("/#")) | (F.col("pages") >= TEMPLATE_PAGES))
    tokens = stage(tokens.withColumn("vector", (F.col("vector") % F.lit(1 << 62)).cast("long")), "tokens")
    totals = tokens.where(F.col("path") == "").select("host", F.col("pages").alias("of"))
    return tokens.join(totals, "host").where(F.col("pages") * 2 >= F.col("of"))


def nests(paths: list[str]) -> bool:
    """A class is valid if its tokens share one ancestor among them or one parent."""
    shortest = min(paths, key=len)
    parent = shortest.rpartition("/")[0]
    return all(p == shortest or p.startswith((shortest + "/", parent + "/")) for p in paths)


def is_text(path: str) -> bool:
    return path.rpartition("/")[2].startswith("#")


def deduce(group: pd.DataFrame) -> pd.DataFrame:
    """The main slot and the template's text blocks of one host from its frequent tokens."""
    of = int(group["of"].iloc[0])
    classes: dict[int, list[str]] = {}
    for path, vector in zip(group["path"], group["vector"]):
        classes.setdefault(int(vector), []).append(path)
    chars = dict(zip(group["path"], group["chars"]))
    once = dict(zip(group["path"], group["once"]))
    valid = {p for paths in classes.values() if nests(paths) for p in paths}
    on_pages = dict(zip(group["path"], group["pages"]))
    template = [p for p in sorted(valid) if is_text(p) and on_pages[p] * 10 >= of * 9]
    if of < TEMPLATE_PAGES or sum(chars[p] for p in template) * 2 > chars[""]:
        template = []
    for p in template:
        n = chars[p]
        while p:
            p = p.rpartition("/")[0]
            if p in chars:
                chars[p] -= n
    # The outermost template: elements of valid classes that nearly every page has once.
    outer = {p for p in valid if not is_text(p) and once[p] * 10 >= of * 9}
    at = ""
    while True:
        inside = [p for p in outer if p.rpartition("/")[0] == at and p]
        best = max(inside, key=lambda p: (chars[p], p), default=None)
        # What a step leaves behind is lost, so that no text may stand beside the way down.
        if best is None or chars[best] < max(1, chars[at]):
            break
        at = best
    # A heading or paragraph alone is no slot: its parent is.
    while re.fullmatch(r"(h[1-6]|p|li|td|tr|blockquote|pre)(\..*)?", at.rpartition("/")[2]):
        at = at.rpartition("/")[0]
    return pd.DataFrame({"host": [group["host"].iloc[0]], "slot": [at], "enough": [of >= TEMPLATE_PAGES], "template": [template]})


def main_slots(pages: DataFrame) -> DataFrame:
    """(host, slot, enough, template): each host's main slot and the text blocks of its template.

    enough: the host has enough pages to tell its template.
    """
    schema = "host string, slot string, enough boolean, template array<string>"
    return token_classes(pages).groupBy("host").applyInPandas(deduce, schema)


def slot_text(page: str, slot: str, enough: bool = False, template: frozenset[str] = frozenset()) -> str:
    """The text of the slot without boilerplate; of the whole page if the slot is not there."""
    own = enough and slot.rpartition("/")[2].partition(".")[0] not in ("", "html", "body")
    inside, kept, fixed = [], [], []
    for path, text, boilerplate in blocks(page):
        if not text or boilerplate == BY_TAG:
            continue
        in_slot = not slot or path == slot or path.startswith(slot + "/")
        if boilerplate and not (own and in_slot):
            continue
        if template and block_token(path, text) in template:
            fixed.append(text)
            continue
        kept.append(text)
        if in_slot:
            inside.append(text)
    return " ".join(inside or kept or fixed)


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    read = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        F.col(page).alias("html"),
        host(F.col(url)).alias("host"),
        F.pmod(F.xxhash64(F.col(page), F.col(page_id)), F.lit(1 << 61)).alias("number"),
    )
    slots = stage(main_slots(read), "slots")
    small = slots.count() <= BROADCAST_HOSTS
    joined = read.drop("number").join(F.broadcast(slots) if small else slots, "host", "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(2, 6)))
            texts = [slot_text(h or "", s or "", bool(e), frozenset(t or ())) for h, s, e, t in rows]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema[page_id].dataType.simpleString()
    found = joined.select("page_id", "url", "html", "slot", "enough", "template")
    return found.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
