"""Main text of web pages by what repeats across the pages of a host, with the page's own structure as an input.

Every page becomes a stream of blocks. Structure says what may be main text: parts that are marked
as something else (menus, adverts, forms, comments and the like) are left out, and where a page marks
its article (an article or main element, or role=main) only the article's blocks stand in the stream.
A part is marked by a whole name in its class, id or role, which may be made of several marks
("cookie-notice") and words for parts of a page ("comment-list"); a name that says more
("has-sidebar", "nav-open") tells of a state and drops nothing. Where all articles of a page stand
inside marked parts, the marks are of their wrappers and the articles are taken.

The streams of a host are then one text whose suffixes are compared, LONG tokens of each, at every
place; blocks shorter than LONG are compared whole. Equal suffixes have equal anchors, the least hash
of ANCHOR neighbours in them, of which there are few: anchors are counted first, and only suffixes
whose anchor is on enough pages are counted themselves. Equal prefixes are counted over the host's distinct
streams (partial counts first, so that a menu of a large host is no hot key). What a share of the
host's pages has is boilerplate: a small share on pages that mark no article, where all tokens it
covers go and the unique runs are kept in page order; most of the host's pages inside an article,
where only blocks that it covers whole go, so that articles which quote one another stay whole.

Suffixes are cut off after LONG tokens and ordered by their hash, as the rule needs classes of equal
prefixes and no longer ones.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.decontaminate import shingle_hashes, word_hashes
from strandloom.llm.jaccard_join import mixed
from strandloom.llm.memory import in_small_batches
from strandloom.llm.suffix_index import _parts, in_slots, slot_of, slots_of, window_minimum
from strandloom.plans.session import table, written

SQL = None
#: Tokens of a suffix that are compared, and neighbours whose least hash is the suffix's anchor.
LONG, ANCHOR = 12, 3
#: Distinct pages of a host, and the share of them, that make a run boilerplate: on pages without an article, and inside one.
FREE, INSIDE = (3, 0.1), (20, 0.6)
#: Elements by what they do, and words in class, id or role that mark a part as no main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe svg select object".split())
DROPPED = frozenset("nav footer aside form button dialog menu head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer modal menu nav navbar navigation newsletter notice pagination popup promo"
    " recommended related replies respond search share sharing sidebar social sponsor sponsored subscribe widget".split()
)
#: Marks that count outside the article only: an article may have a header of its own.
OUTSIDE = frozenset("header masthead topbar".split())
#: Words that may stand beside a mark in one name.
PARTS = frozenset("area bar block box button buttons container form inner item items link links list main outer primary secondary section site slot unit wrap wrapper".split())
#: Elements of RAW that a parser leaves again when no end tag follows.
OPEN = frozenset("noscript svg select object".split())
_MAIN = re.compile(r"<(?:article|main)[\s>/]|<[a-z][^>]*\brole\s*=\s*[\"']?main\b", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CLOSED = re.compile(r"(?<![^\s\"'])/$|(?:^|[\s\"'])[^\s=\"']*(?<!=)/$")
_HIDDEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|template|textarea|title|iframe)\b.*?(?:</\1|$)", re.S | re.I)
_ROLE = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)
_WORD = re.compile(r"[a-z]+")


def has_main(page: str) -> bool:
    """Whether an element marks the article; what stands in comments and scripts is none."""
    return _MAIN.search(page) is not None and _MAIN.search(_HIDDEN.sub(" ", page)) is not None


def main_blocks(page: str) -> tuple[bool, list[str]]:
    """Whether the page marks an article with text, and the blocks that may be main text.

    An article inside a main element is the story, unless the element holds more than twice as much
    beside it; then it is a teaser in the story.
    """
    if not has_main(page):
        return False, blocks_of(page, None)[1]
    shown = _HIDDEN.sub(" ", page).lower()
    main = blocks_of(page, "main" if "<article" not in shown else "article")[0]
    if "<article" in shown and ("<main" in shown or _ROLE.search(shown)):
        around = blocks_of(page, "main", True)[0]
        if sum(map(len, around)) > 2 * sum(map(len, main)):
            main = around
    return (True, main) if main else (False, blocks_of(page, None)[1])


def marked(names: list[str], marks: frozenset[str]) -> bool:
    """Whether one of the names is made of marks, or of marks and PARTS."""
    return any(not marks.isdisjoint(words) and all(w in marks or w in PARTS for w in words) for words in map(_WORD.findall, names))


def blocks_of(page: str, story: str | None = "article", teasers: bool = False) -> tuple[list[str], list[str]]:
    """(blocks inside elements `story`, other blocks), decoded, white space made one, parts marked as something else left out; with `teasers`, articles too."""
    main: list[str] = []
    other: list[str] = []
    rescued: list[str] = []
    held: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name, inside main, dropped
    inside = dropped = 0  # inside: 2 in an article whose wrapper is marked; dropped: 1 by a mark or form, 2 by what the element is
    unclosed: set[str] = set()
    at, n = 0, len(page)

    def close() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text and not dropped:
                (other, main, rescued)[inside].append(text)

    while at < n:
        tag = _TAG.search(page, at)
        if tag is None:
            held.append(page[at:])
            break
        if tag.start() > at:
            held.append(page[at : tag.start()])
        at = max(tag.end(), tag.start() + 1)
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            close()
        if tag[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if stack[k][1:] != (inside, dropped) or any(x[1:] != stack[k][1:] for x in stack[k:]):
                        close()
                    inside, dropped = stack[k][1], stack[k][2]
                    del stack[k:]
                    break
            continue
        attributes = tag[3] or ""
        if name in VOID or _CLOSED.search(attributes):
            continue
        if name in RAW:
            end = None if name in unclosed else re.compile(rf"</{name}[^>]*(?:>|$)", re.I).search(page, at)
            if end is None:
                unclosed.add(name)
            at = end.end() if end else at if name in OPEN else n
            continue
        said = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        enters = inside or int(story is not None and (name == story or (story == "main" and _ROLE.search(attributes) is not None)))
        drops = dropped
        if enters and not inside:
            if dropped == 1:
                enters, drops = 2, 0
            # the article itself isn't dropped for its name
        else:
            names = " ".join(said[x] for x in ("class", "id", "role") if x in said).split()
            if (name in DROPPED and name != "form") or (teasers and name == "article") or (not enters and name == "header") or said.get("hidden", "false") != "false" or said.get("aria-hidden") == "true":
                drops = 2
            elif not drops and (name == "form" or (name not in ("html", "body") and (marked(names, MARKS) or (not enters and marked(names, MARKS | OUTSIDE))))):
                drops = 1
        if (enters, drops) != (inside, dropped):
            close()
        stack.append((name, inside, dropped))
        inside, dropped = enters, drops
    close()
    return main or rescued, other


def parsed(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(page, url, host, stream, inside, blocks) of every row; host and stream are hashes of the host name and of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_blocks(said.as_py()) for said in batch.column(3)]
            streams = [xxhash.xxh3_64_intdigest("\0".join(b)) - (1 << 63) for _, b in found]
            made = [pa.array(streams, pa.int64()), pa.array([i for i, _ in found], pa.bool_()), pa.array([b for _, b in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *made], names=[page, "url", "host", "stream", "inside", "blocks"])

    kinds = dict(pages.dtypes)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    chosen = in_small_batches(pages).select(page, "url", F.xxhash64(host).alias("host"), F.coalesce(html, F.lit("")).alias(html))
    return chosen.mapInArrow(run, f"`{page}` {kinds[page]}, url {kinds['url']}, host long, stream long, inside boolean, blocks array<string>")


def suffixes_of(streams: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stream, at, n, key, anchor) of every suffix's first LONG tokens, and of all shorter blocks whole; streams count from 0, places in tokens.

    The anchor is the least hash of ANCHOR neighbours inside the suffix, or a short block's key.
    """
    words = [[w.encode() for b in blocks for w in b.split()] for blocks in streams]
    hashes = word_hashes(list(chain.from_iterable(words)))
    keys, ends = shingle_hashes(hashes, LONG), np.cumsum([len(w) for w in words])
    parts = shingle_hashes(hashes, ANCHOR)
    least = window_minimum(parts, LONG - ANCHOR + 1) if len(keys) else keys
    starts = np.concatenate(([0], ends))
    short = []
    for number, blocks in enumerate(streams):
        own = 0
        for block in blocks:
            n = block.count(" ") + 1
            if n < LONG:
                short.append((number, own, n, xxhash.xxh3_64_intdigest(block, 1)))
            own += n
    place = np.arange(len(keys))
    number = np.searchsorted(ends, place, side="right")
    inner = place + LONG <= starts[number + 1]  # others would run into the next stream
    place, number = place[inner], number[inner]
    found = [number, place - starts[number], np.full(len(place), LONG), keys[place], least[place]]
    more = [np.array(x, np.uint64) for x in zip(*short, strict=True)] if short else [np.zeros(0, np.uint64)] * 4
    return tuple(np.concatenate((x.astype(y.dtype) if k < 3 else x, y)) for k, (x, y) in enumerate(zip(found, [*more, more[3]], strict=True)))


def of_host(key: np.ndarray, number: np.ndarray, hosts: np.ndarray) -> np.ndarray:
    return mixed(key + hosts.view(np.uint64)[number])


def small(anchor: np.ndarray) -> np.ndarray:
    """Anchors in 32 bits: two in one let more through the filter, and lose nothing."""
    return (anchor >> np.uint64(32)).astype(np.uint32).view(np.int32)


def anchors(streams: DataFrame) -> DataFrame:
    """(host, anchor) of every suffix of every stream, once for a stream. streams: (host, stream, inside, blocks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 200):
            hosts = part.column(0).to_numpy()
            number, _, _, _, anchor = suffixes_of(part.column(3).to_pylist())
            once = np.unique(number.astype(np.uint64) << np.uint64(32) | small(of_host(anchor, number, hosts)).view(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array(hosts[(once >> np.uint64(32)).astype(np.int64)]), pa.array(once.astype(np.uint32).view(np.int32))], names=["host", "anchor"])

    return streams.select("host", "stream", "inside", "blocks").mapInArrow(run, "host long, anchor int")


def suffix_keys(streams: DataFrame, often: DataFrame) -> DataFrame:
    """(host, key) of every suffix that has an anchor of `often`, once for a stream. streams: (host, stream, inside, blocks); key is of host and suffix."""
    shared = streams.sparkSession.sparkContext.broadcast(slots_of(often.select(F.col("anchor").cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 200):
            hosts = part.column(0).to_numpy()
            number, _, _, key, anchor = suffixes_of(part.column(3).to_pylist())
            keep = in_slots(shared.value, slot_of(small(of_host(anchor, number, hosts)).astype(np.int64).view(np.uint64)))
            number, key = number[keep], of_host(key[keep], number[keep], hosts)
            once = np.unique(np.rec.fromarrays((number, key)))
            yield pa.RecordBatch.from_arrays([pa.array(hosts[once.f0.astype(np.int64)]), pa.array(once.f1.view(np.int64))], names=["host", "key"])

    return streams.select("host", "stream", "inside", "blocks").mapInArrow(run, "host long, key long")


def suffix_places(streams: DataFrame, keys: DataFrame) -> DataFrame:
    """(host, stream, inside, key, at, n) of all suffixes with a key of `keys`; most others are kept from travelling by a filter of fixed size."""
    shared = streams.sparkSession.sparkContext.broadcast(slots_of(keys.select("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 200):
            number, at, n, key, _ = suffixes_of(part.column(3).to_pylist())
            key = of_host(key, number, part.column(0).to_numpy())
            keep = in_slots(shared.value, slot_of(key))
            own = pa.array(number[keep].astype(np.int64))
            made = [pa.array(key[keep].view(np.int64)), pa.array(at[keep].astype(np.int32)), pa.array(n[keep].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(own) for k in range(3)), *made], names=["host", "stream", "inside", "key", "at", "n"])

    return streams.select("host", "stream", "inside", "blocks").mapInArrow(run, "host long, stream long, inside boolean, key long, at int, n int").join(keys, "key")


def boilerplate(found: DataFrame, free: tuple[int, float] = FREE, inside: tuple[int, float] = INSIDE) -> DataFrame:
    """(host, stream, covered): where boilerplate covers each stream, as (at, n). found: (row, host, stream, inside, blocks), written; rows of a host with equal streams count as one."""
    same = found.groupBy("host", "stream").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    copies = found.select("row", "host", "stream").join(same.filter("n > 1").select("host", "stream", F.col("row").alias("first")), ["host", "stream"]).filter("row <> first")
    streams = found.join(written(copies.select("row"), "copied-streams"), "row", "left_anti")
    hosts = found.groupBy("host").agg(F.countDistinct("stream").alias("pages"), F.bool_or(~F.col("inside")).alias("open"))
    enough = lambda rule: (F.col("n_pages") >= rule[0]) & (F.col("n_pages") >= rule[1] * F.col("pages"))
    counted = lambda keys, key: keys.groupBy("host", key).agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= free[0]).join(hosts, "host").filter(enough(free) & (F.col("open") | enough(inside)))
    known = written(counted(anchors(streams), "anchor").select("anchor"), "boilerplate-anchors")
    often = written(counted(suffix_keys(streams, known), "key").select("key", enough(inside).alias("most")), "boilerplate-keys")
    places = suffix_places(streams, often).filter("most OR NOT inside")
    return places.groupBy("host", "stream").agg(F.collect_set(F.struct("at", "n")).alias("covered"))


def unique_text(blocks: list[str], inside: bool, covered: list[dict] | None) -> str:
    """The blocks without what is covered: tokens, or inside an article blocks that are covered whole."""
    if not covered:
        return " ".join(blocks)
    tokens = [b.split(" ") for b in blocks]
    gone = np.zeros(sum(map(len, tokens)), bool)
    for c in covered:
        gone[c["at"] : c["at"] + c["n"]] = True
    kept, at = [], 0
    for words in tokens:
        own = gone[at : at + len(words)]
        at += len(words)
        if inside:
            kept += [] if own.all() else words
        else:
            kept += [w for w, g in zip(words, own.tolist(), strict=True) if not g]
    return " ".join(kept)


def main_text(pages: DataFrame, page: str = "page_id", html: str = "html", free: tuple[int, float] = FREE, inside: tuple[int, float] = INSIDE) -> DataFrame:
    """(page, url, text, n_chars) of every row of `pages`.

    Null and empty html give an empty text, a null or odd url belongs to the host "". Repeated rows
    stay rows; pages of a host with equal blocks count as one. Other columns are ignored; an empty
    table gives no rows. A very long page is one row of its task.
    """
    found = written(parsed(pages.select(page, "url", html), page, html).withColumn("row", F.monotonically_increasing_id()), "parsed-pages")
    covered = written(boilerplate(found, free, inside), "covered")
    # written, so that Spark knows its size and moves the blocks only where it is large
    joined = found.join(covered, ["host", "stream"], "left").select(page, "url", "inside", "blocks", "covered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)
            texts = [unique_text(blocks, main, over) for blocks, main, over in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[page, "url", "text"])

    kinds = dict(pages.dtypes)
    out = joined.mapInArrow(run, f"`{page}` {kinds[page]}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))
