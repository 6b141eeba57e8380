"""Main text of web pages by wrappers of their hosts.

1. One Arrow pass reads each page: its blocks of text, and its own token stream with
   repeats folded (a shape). Blocks are written once, with their places in the shape.
2. Shapes are counted by host, so that pages of one make are one row. Wrappers are
   inferred by aligning a host's shapes: first those of each of BUCKETS parts of a host,
   then the parts' wrappers. Each task holds one wrapper at a time, and no host is one
   task, however many pages it has. Shapes come in the order of their digests, so the
   result doesn't depend on how pages are dealt out.
3. Aligning each shape with its host's wrapper tells which text place of the wrapper each
   of its places is. Characters, characters in links and digests of texts are summed by
   shape, then by host and place.
4. For each shape (not each page) the places of the main text are chosen (`chosen`), and
   each page keeps the blocks in them.

What is left out: places inside elements whose tag or names say that they are menus,
headers, footers, sidebars, adverts, notices, forms, comments, sharing or related items;
places with the same text on all of a host's pages; places that are mostly links. What is
kept of the rest lies in article or main elements where a page has them with a fair part
of its text, else in the innermost container with nearly all of it, and its h1.

Defined cases: a null or empty page, or one without blocks, has the text ''; a null url
or one without a host belongs to the host ''; repeated rows and null ids are kept as
rows; pages of any length are read whole; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .html_blocks import Page, text_key
from .wrappers import dumps, expression, leaves, merged, numbered, of_page, places

#: Parts of a host whose wrappers are inferred apart and then aligned.
BUCKETS = 64
#: A text is its host's own, not a page's, if it is the same on all of so many pages at least.
TEMPLATE_PAGES = 3
#: A place in a container is a list of links if so many of 100 characters are in links.
LINK_SHARE = 60
#: article and main are trusted with so many of 100 characters of a page's usual text.
TRUSTED_SHARE = 15
#: A container is entered if it has so many of 100 characters of its parent.
INNER_SHARE = 80
#: The same for one that is named for its text.
NAMED_SHARE = 40
#: Keys with more than this share of rows are joined by broadcast: fewer than so many of them exist.
HOT_SHARE = 1_000

BLOCKS = "page_id long, url string, host string, shape string, place array<int>, chars array<long>, links array<long>, keys array<long>, texts array<string>"
_LISTS = {"place": pa.int32(), "chars": pa.int64(), "links": pa.int64(), "keys": pa.int64(), "texts": pa.string()}
_SIMPLE = frozenset(("article", "main"))
_DROPPED = frozenset("nav aside footer form button select option optgroup datalist menu dialog head svg canvas object audio video map template fieldset legend applet search".split())
_UNWANTED = frozenset("nav foot side ad notice comment share related form hidden".split())
#: Uses that hold even around an article.
_FIRM = frozenset(("comment", "hidden", "related"))
_CONTAINER = frozenset("html body div section article main center table tbody tr td form span header".split())
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def blocks(pages: DataFrame) -> DataFrame:
    """BLOCKS of each page: place says where in the shape each text is, the other lists are by place."""

    def read(html: str | None) -> tuple[str, list, list, list, list, list]:
        page = Page(html or "")
        shape = of_page(page.root)
        by_place = [leaf[1] for leaf in leaves(shape)]
        place = [0] * len(page.texts)
        for k, own in enumerate(by_place):
            own.sort()
            for block in own:
                place[block] = k
        chars = [sum(len(page.texts[b]) for b in own) for own in by_place]
        links = [sum(page.links[b] for b in own) for own in by_place]
        keys = [text_key([page.texts[b] for b in own]) for own in by_place]
        return dumps(numbered(shape)), place, chars, links, keys, page.texts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, rows = 0, 0, []
            for k, html in enumerate(batch.column(3)):
                rows.append(read(html.as_py()))
                size += sum(rows[-1][2])
                if size > 4_000_000 or k + 1 == batch.num_rows:
                    head = [batch.column(i).slice(start, len(rows)) for i in range(3)]
                    shape, *lists = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([*head, pa.array(shape), *(pa.array(x, pa.list_(t)) for x, t in zip(lists, _LISTS.values(), strict=True))], names=["page_id", "url", "host", "shape", *_LISTS])
                    start, size, rows = k + 1, 0, []

    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(run, BLOCKS)


def _taught(keys: int) -> object:
    """Aligns the wrappers (last column) of rows that agree in their first `keys` columns and come one after the other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, wrapper, n, out = None, None, 0, []

        def done() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns[:keys], (pa.string(), pa.int32()), strict=False)), pa.array(columns[-2], pa.int64()), pa.array(columns[-1])], names=["host", "bucket"][:keys] + ["shapes", "wrapper"])

        for batch in batches:
            columns = batch.to_pydict()
            for row in zip(*columns.values(), strict=True):
                if row[:keys] != own:
                    if own is not None:
                        out.append((*own, n, dumps(numbered(wrapper))))
                    own, wrapper, n = row[:keys], None, 0
                wrapper, n = merged(wrapper, row[-1]), n + row[-2]
                if len(out) >= 1000:
                    yield done()
        if own is not None:
            out.append((*own, n, dumps(numbered(wrapper))))
            yield done()

    return run


def wrappers(shapes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """host, shapes (how many), wrapper, from host, key, shape."""
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
    first = shapes.select("host", bucket, "key", F.lit(1).cast("long").alias("shapes"), "shape").repartition("host", "bucket").sortWithinPartitions("host", "bucket", "key").drop("key")
    parts = first.mapInArrow(_taught(2), "host string, bucket int, shapes long, wrapper string")
    second = parts.repartition("host").sortWithinPartitions("host", "bucket").drop("bucket")
    return second.mapInArrow(_taught(1), "host string, shapes long, wrapper string")


def meet(rows: DataFrame, facts: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join with one row of facts for each key; weight is how many rows have the key. Keys of many rows (fewer than HOT_SHARE) are broadcast."""
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT_SHARE > total
    return rows.join(F.broadcast(facts.where(hot).drop(weight)), on).unionByName(rows.join(facts.where(~hot).drop(weight), on))


def chosen(shape: list, usual: list[tuple[float, int, bool]]) -> list[int]:
    """Places of the main text in a numbered shape. usual: of each place its characters a page, percent of them in links, and whether its text is the host's own."""
    weight: dict[int, float] = {}
    trusted, heads = [], []

    def use(node: list) -> tuple[str, set[str]]:
        name = node[0].partition(".")[0]
        tag, _, uses = name.partition(":")
        return tag, set(uses.split(",")) - {""}

    def has_main(node: list, or_else: frozenset[str]) -> bool:
        """Whether an article, a main element, or a tag or use of `or_else` is inside, itself not of an unwanted use."""
        if node[0] == "#":
            return False
        for item in node[1]:
            for _, inner in item[2]:
                tag, uses = use(inner)
                if uses & _FIRM or tag in _DROPPED:
                    continue
                if (not uses & _UNWANTED and (tag in _SIMPLE or "main" in uses or or_else & {tag, *uses})) or has_main(inner, or_else):
                    return True
        return False

    def unwanted(tag: str, uses: set[str], node: list, inside: bool) -> bool:
        if tag in ("html", "body"):
            return False
        if uses & _FIRM:
            return True
        if tag in _SIMPLE and not uses & _UNWANTED:
            return False
        if tag in _HEADING:
            return bool(uses & {"share", "notice", "ad"})
        if not inside and (tag == "header" or "head" in uses):
            return not has_main(node, frozenset())
        if tag not in _DROPPED and not uses & _UNWANTED:
            return False
        # A form may be around a whole page, and a container may be named for what stands beside its text.
        return not has_main(node, frozenset(("h1", "body")) if tag == "form" else frozenset(("h1",)))

    def walk(node: list, inside: bool, certain: bool, in_heading: bool, path: str) -> float:
        if node[0] == "#":
            k = node[1][0]
            chars, links, fixed = usual[k]
            if fixed and not in_heading or (links >= LINK_SHARE and not certain and not in_heading):
                return 0.0
            weight[k] = chars
            if inside:
                trusted.append(k)
            if path == "h1" and not fixed:
                heads.append(k)
            return chars
        tag, uses = use(node)
        if unwanted(tag, uses, node, inside):
            return 0.0
        is_main = tag in _SIMPLE or "main" in uses
        total = sum(walk(m, inside or is_main, certain or tag == "article", in_heading or tag in _HEADING, tag) for item in node[1] for _, m in item[2])
        sizes[id(node)] = total
        return total

    sizes: dict[int, float] = {}
    whole = walk(shape, False, False, False, "")
    if trusted and sum(weight[k] for k in trusted) * 100 >= TRUSTED_SHARE * whole:
        return sorted(trusted)
    node = shape
    while True:
        inside = [(sizes.get(id(m), 0.0), item[1], m) for item in node[1] for _, m in item[2] if m[0] != "#"]
        size, repeated, inner = max(inside, key=lambda x: x[0], default=(0.0, False, None))
        if not size or repeated or any(use(m)[0] in _HEADING and n for n, _, m in inside):
            break
        tag, uses = use(inner)
        if tag not in _CONTAINER or size * 100 < (NAMED_SHARE if "body" in uses else INNER_SHARE) * sizes.get(id(node), 0.0):
            break
        node = inner
    kept = {leaf[1][0] for leaf in leaves(node)} & weight.keys()
    return sorted(kept | set(heads))


def _chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for shape, places_of, usual in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
            known = {x["place"]: (x["chars"] / x["pages"], x["links"] * 100 // x["chars"] if x["chars"] else 0, bool(x["fixed"])) for x in usual}
            kept.append(chosen(json.loads(shape), [known.get(k, (0.0, 0, False)) for k in places_of]))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(kept, pa.list_(pa.int32()))], names=["host", "key", "pages", "kept"])


def _placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [places(json.loads(s), json.loads(w)) for s, w in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(found, pa.list_(pa.int32()))], names=["host", "key", "pages", "shape", "places"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    held = materialise(blocks(pages).withColumn("key", F.sha2("shape", 256)), "blocks")
    shapes = materialise(held.groupBy("host", "key").agg(F.first("shape").alias("shape"), F.count("*").alias("pages")), "shapes")
    learnt = materialise(wrappers(shapes), "wrappers")
    placed = materialise(meet(shapes, learnt, ["host"], "shapes").select("host", "key", "pages", "shape", "wrapper").mapInArrow(_placed, "host string, key string, pages long, shape string, places array<int>"), "places")
    # Sums by shape and its places, then by host and the wrapper's places.
    own = held.select("host", "key", F.posexplode(F.arrays_zip("chars", "links", "keys")).alias("k", "x")).groupBy("host", "key", "k").agg(
        F.count("*").alias("pages"), F.sum("x.chars").alias("chars"), F.sum("x.links").alias("links"), F.min("x.keys").alias("low"), F.max("x.keys").alias("high")
    )
    by_place = placed.select("host", "key", F.posexplode("places").alias("k", "place"))
    sums = own.join(by_place, ["host", "key", "k"]).groupBy("host", "place").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.min("low").alias("low"), F.max("high").alias("high"))
    same = (F.col("pages") >= TEMPLATE_PAGES) & (F.col("low") == F.col("high"))
    usual = sums.groupBy("host").agg(F.collect_list(F.struct("place", "pages", "chars", "links", same.alias("same"))).alias("usual"))
    # Where all of a host's pages are copies, every text is the same on all, which says nothing.
    fixed = F.transform("usual", lambda x: F.struct(x["place"].alias("place"), x["pages"].alias("pages"), x["chars"].alias("chars"), x["links"].alias("links"), (x["same"] & F.exists("usual", lambda y: (y["pages"] >= TEMPLATE_PAGES) & ~y["same"])).alias("fixed")))
    facts = learnt.select("host", "shapes").join(usual.select("host", fixed.alias("usual")), "host", "left").fillna(0, ["shapes"])
    facts = materialise(facts.withColumn("usual", F.coalesce("usual", F.array().cast("array<struct<place:int,pages:bigint,chars:bigint,links:bigint,fixed:boolean>>"))), "usual")
    kept = materialise(meet(placed, facts, ["host"], "shapes").select("host", "key", "pages", "shape", "places", "usual").mapInArrow(_chosen, "host string, key string, pages long, kept array<int>"), "kept")
    text = F.array_join(F.transform("texts", lambda t, i: F.when(F.array_contains("kept", F.get("place", i)), t)), "\n")
    return meet(held.select("page_id", "url", "host", "key", "place", "texts"), kept, ["host", "key"], "pages").select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def wrapper_expressions(pages: DataFrame) -> DataFrame:
    """host and its wrapper as an expression, to look at."""
    shapes = blocks(pages).select("host", "shape", F.sha2("shape", 256).alias("key")).distinct()
    shown = F.udf(lambda w: expression(json.loads(w)), "string")
    return wrappers(shapes).select("host", "shapes", shown("wrapper").alias("expression"))


def op13_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
