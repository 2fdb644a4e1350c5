"""Documents -> one row per XML element, and the text fragments they hold.

The only Python here turns one document's tree into flat rows and marks, along each path,
which elements have a container or a quoted block below them and which are headed as
definitions. What that means (sections, citations, terms, amendments) is decided by DataFrame
code over these rows, mostly without looking at any other row.
"""
from __future__ import annotations

import itertools
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave import fixed
from lexweave.functions.text import clean_inline
from lexweave.session import ship_package

NODE_SCHEMA = (
    "bill_id string, error string, body_pos int, body_depth int, has_body boolean, pos int, end int, tag string, id string,"
    "legal_doc string, cite string, date string, stage string, text string, tail string,"
    "path array<struct<pos:int,end:int,tag:string,id:string,holds:boolean,quotes:boolean,defines:boolean>>"
)
_ATTRS = ["id", "legal-doc", "parsable-cite", "date", "bill-stage"]
_MARKS = ["holds", "quotes", "defines"]
_LEVELS = frozenset(fixed.LEVELS)
BATCH_ROWS = 4096
_PATH = pa.struct([("pos", pa.int32()), ("end", pa.int32()), ("tag", pa.string()),
                   ("id", pa.string()), *((m, pa.bool_()) for m in _MARKS)])


def _tree_rows(root: ET.Element) -> dict:
    """Document order columns of a tree; ``pos``/``end`` number the start and end events."""
    out = {k: [] for k in ("pos", "end", "tag", "text", "tail", "chain", *_MARKS, *_ATTRS)}
    pos, end, tags, texts, tails, chains = (out[k] for k in ("pos", "end", "tag", "text", "tail", "chain"))
    marks, attrs = [out[m] for m in _MARKS], [(out[a], a) for a in _ATTRS]
    clock, todo, headed = 0, [(root, (), None)], set()
    while todo:
        elem, chain, closing = todo.pop()
        if closing is not None:
            end[closing] = clock
            clock += 1
            continue
        row = len(pos)
        chain += (row,)
        tag = elem.tag.rsplit("}", 1)[-1]
        pos.append(clock)
        end.append(-1)
        tags.append(tag)
        texts.append(elem.text)
        tails.append(elem.tail)
        chains.append(chain)
        for m in marks:
            m.append(False)
        get = elem.attrib.get
        for column, name in attrs:
            column.append(get(name))
        mark = "holds" if tag in _LEVELS else "quotes" if tag == "quoted-block" else None
        for above in chain[:-1] if mark else ():
            out[mark][above] = True
        if tag in fixed.HEADING_TAGS and len(chain) > 1 and chain[-2] not in headed:
            headed.add(chain[-2])
            out["defines"][chain[-2]] = bool(re.match(fixed.DEFINITIONS_HEADING, " ".join(" ".join(elem.itertext()).split())))
        clock += 1
        todo.append((elem, chain, row))
        todo.extend((child, chain, None) for child in reversed(elem))
    return out


def _document(bill_id: str, xml: bytes) -> dict:
    """The columns of one document, without what all its rows share spelled out per row."""
    try:
        rows, error = _tree_rows(ET.fromstring(xml)), None
    except (ET.ParseError, ValueError, LookupError) as e:
        rows, error = _tree_rows(ET.Element("unreadable")), f"{type(e).__name__}: {e}"
    bodies = [rows["tag"].index(t) for t in fixed.BODY_TAGS if t in rows["tag"]]
    at = bodies[0] if bodies else None
    shared = {"bill_id": bill_id, "error": error, "body_pos": 0 if at is None else rows["pos"][at], "has_body": at is not None,
              "body_depth": 1 if at is None else len(rows["chain"][at])}
    return rows | {"shared": shared}


def _documents_batch(docs: list[dict]) -> pa.RecordBatch:
    """The rows of some documents as one batch."""
    every = lambda k: list(itertools.chain.from_iterable(d[k] for d in docs))
    col = {k: pa.array(every(k), pa.int32()) for k in ("pos", "end")}
    col |= {k: pa.array(every(k), pa.string()) for k in ("tag", "text", "tail", *_ATTRS)}
    elements = pa.StructArray.from_arrays(
        [col["pos"], col["end"], col["tag"], col["id"], *[pa.array(every(m), pa.bool_()) for m in _MARKS]],
        fields=list(_PATH))
    offsets, flat, base = [0], [], 0
    for d in docs:
        for steps in d["chain"]:
            flat.extend([base + i for i in steps])
            offsets.append(len(flat))
        base += len(d["pos"])
    path = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), elements.take(pa.array(flat, pa.int32())))
    of = pa.array([i for i, d in enumerate(docs) for _ in d["pos"]], pa.int32())
    shared = {k: pa.array([d["shared"][k] for d in docs], t).take(of) for k, t in (
        ("bill_id", pa.string()), ("error", pa.string()), ("body_pos", pa.int32()), ("body_depth", pa.int32()), ("has_body", pa.bool_()))}
    return pa.RecordBatch.from_arrays(
        [*shared.values(), col["pos"], col["end"], col["tag"], *[col[a] for a in _ATTRS], col["text"], col["tail"], path],
        names=[*shared, "pos", "end", "tag", "id", "legal_doc", "cite", "date", "stage", "text", "tail", "path"])


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small documents share a batch: one of about ``BATCH_ROWS`` rows, or a single document."""
    some, n = [], 0
    for batch in batches:
        for bill_id, xml in zip(batch.column(0).to_pylist(), batch.column(1)):
            some.append(_document(bill_id, xml.as_py()))
            n += len(some[-1]["pos"])
            if n >= BATCH_ROWS:
                yield _documents_batch(some)
                some, n = [], 0
    if some:
        yield _documents_batch(some)


def elements(docs: DataFrame) -> DataFrame:
    """One row per XML element of ``docs(bill_id, xml binary)``.

    An unreadable document yields a single row that carries ``error``.
    """
    ship_package(docs.sparkSession)
    return docs.select("bill_id", "xml").mapInArrow(_flatten, NODE_SCHEMA)


def quarantine(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("error").isNotNull()).select("bill_id", "error")


# -- path predicates -------------------------------------------------------
def is_level(p: Column) -> Column:
    return p["tag"].isin(fixed.LEVELS)


def is_wrapper(p: Column) -> Column:
    return p["tag"].isin(fixed.WRAPPERS)


def is_quoted(p: Column) -> Column:
    return p["tag"] == "quoted-block"


def has_id(p: Column) -> Column:
    return p["id"].isNotNull() & (p["id"] != "")


def in_body(nodes: DataFrame) -> DataFrame:
    """Readable elements strictly inside the body, with their path from the body down."""
    depth = F.col("body_depth")
    return (
        nodes.where(F.col("error").isNull() & (F.get("path", depth - 1)["pos"] == F.col("body_pos")) & (F.size("path") > depth))
        .withColumn("rel", F.slice("path", depth + 1, F.size("path")))
        .drop("path", "body_depth")
    )


def outside_quotes(rel: str = "rel") -> Column:
    return ~F.exists(rel, is_quoted)


def above(rel: str = "rel") -> Column:
    """The path without the element itself."""
    return F.slice(F.col(rel), F.lit(1), F.greatest(F.size(rel) - 1, F.lit(0)))


_KEEP_EMPTY = [*fixed.LEVELS, *fixed.ENUM_TAGS, *fixed.HEADING_TAGS, "br", "p", "td", "th"]


def fragments(nodes: DataFrame) -> DataFrame:
    """Text pieces in document order: ``bill_id, ord, txt, opens, tag, rel, has_body``.

    An element's text belongs to it, its tail to its parent. Structural elements keep an empty
    piece so that they are seen even without text.
    """
    body = in_body(nodes)
    pieces = F.array(
        F.struct(F.col("pos").alias("ord"), F.coalesce("text", F.lit("")).alias("txt"),
                 F.lit(True).alias("opens"), F.col("rel").alias("rel")),
        F.struct(F.col("end").alias("ord"), F.coalesce("tail", F.lit("")).alias("txt"),
                 F.lit(False).alias("opens"), above().alias("rel")),
    )
    return (
        body.select("bill_id", "has_body", "tag", F.inline(pieces))
        .where((F.col("txt") != "") | (F.col("opens") & F.col("tag").isin(_KEEP_EMPTY)))
        .where(F.size("rel") > 0)
    )


def ordered_text(ord_col: str = "ord", txt_col: str = "txt") -> Column:
    """Aggregate: non-empty pieces of one element in order, blank-joined."""
    piece = F.when(F.col(txt_col) != "", F.struct(F.col(ord_col).alias("o"), F.col(txt_col).alias("t")))
    return F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["t"]), " ")


def subtree_text(frags: DataFrame, tags: list[str], skip_quotes: bool, out: str) -> DataFrame:
    """Whitespace-collapsed text below every element of the given tags: ``bill_id, pos, <out>``.

    With ``skip_quotes`` the text of quoted blocks below the element is left out.
    """
    def wanted(p: Column, i: Column) -> Column:
        hit = p["tag"].isin(tags)
        if skip_quotes:
            hit = hit & ~F.exists(F.slice(F.col("rel"), i + 2, F.greatest(F.size("rel") - i - 1, F.lit(0))), is_quoted)
        return F.when(hit, p["pos"])

    found = F.array_compact(F.transform("rel", wanted))
    return (
        frags.where(F.exists("rel", lambda p: p["tag"].isin(tags)))
        .select("bill_id", "ord", "txt", F.explode(found).alias("pos"))
        .groupBy("bill_id", "pos").agg(clean_inline(ordered_text()).alias(out))
    )


def quoting_container_text(frags: DataFrame, out: str) -> DataFrame:
    """Text, outside quoted blocks, of every container that has one below: ``bill_id, pos, <out>``."""
    around = F.transform(F.filter("rel", lambda p: is_level(p) & p["quotes"]), lambda p: p["pos"])
    return (
        frags.where(outside_quotes()).where(F.exists("rel", lambda p: is_level(p) & p["quotes"]))
        .select("bill_id", "ord", "txt", F.explode(around).alias("pos"))
        .groupBy("bill_id", "pos").agg(clean_inline(ordered_text()).alias(out))
    )
