"""Evaluation texts inside training texts, by Wu-Manber multi-pattern search over words.

Patterns are all runs of SPAN words of the items. The search alphabet is words: a table tells for
each block of two words how far the window may shift without missing a pattern (unknown blocks: past
the block, so most words are never looked at); where the shift is 0, the patterns that end with the block
are compared directly.
"""

from __future__ import annotations

import html
import unicodedata
import uuid
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN, BLOCK = 8, 2
#: Characters of item texts searched for in one pass; more items take more passes.
PASS_CHARACTERS = 20_000_000

_TAG = regex.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->|<![A-Za-z][^<>]*>", regex.DOTALL)
_INVISIBLE = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}]+")
_PLAIN = regex.compile(r"[a-z0-9]+")
_WORD = regex.compile(r"[\p{L}\p{Nd}]+")


def words(text: str | None) -> list[str]:
    """The words of a text: tags cut, entities decoded, without case, accents, compatibility forms and
    invisible format characters; an underscore separates."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return _PLAIN.findall(text.lower())
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return _WORD.findall(_INVISIBLE.sub("", text))


class Searcher:
    def __init__(self, items: list[tuple[int, str | None]], span: int = SPAN):
        self.span = span
        self.items: dict[tuple, set[int]] = {}
        for item, text in items:
            w = words(text)
            for i in range(len(w) - span + 1):
                self.items.setdefault(tuple(w[i : i + span]), set()).add(item)
        block = min(BLOCK, span)
        self.block, self.most = block, span - block + 1
        self.shift: dict[tuple, int] = {}
        self.ending: dict[tuple, list[tuple]] = {}
        for p in self.items:
            for end in range(block, span + 1):
                b = p[end - block : end]
                self.shift[b] = min(self.shift.get(b, self.most), span - end)
            self.ending.setdefault(p[-block:], []).append(p)

    def find(self, text: str | None) -> Counter:
        """How many runs of the text occur in each item."""
        hits: Counter = Counter()
        w = words(text)
        n, span, block, most, shift = len(w), self.span, self.block, self.most, self.shift
        end = span
        while end <= n:
            b = tuple(w[end - block : end])
            step = shift.get(b, most)
            if step:
                end += step
                continue
            run = tuple(w[end - span : end])
            for p in self.ending[b]:
                if p[0] == run[0] and p == run:
                    hits.update(self.items[p])
            end += 1
        return hits


_searchers: dict[tuple[str, int], Searcher] = {}


def searcher_of(items, span: int, name: str) -> Searcher:
    """The searcher of a pass, built once for a worker process; that of an earlier pass makes room."""
    key = name, span
    if key not in _searchers:
        _searchers.clear()
        _searchers[key] = Searcher(items.value, span)
    return _searchers[key]


def _search(batches, items, span, name):
    searcher = searcher_of(items, span, name)
    for batch in batches:
        rows, item, runs = [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            for i, n in searcher.find(text).items():
                rows.append(row)
                item.append(i)
                runs.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(item, pa.int64()), pa.array(runs, pa.int64())],
            names=["doc_id", "item_id", "runs"],
        )


def leaks(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, pass_characters: int = PASS_CHARACTERS) -> DataFrame:
    """``(doc_id, item_id, runs)``: documents that contain ``span`` consecutive words of an item.

    ``runs`` is how many positions of the document match. Null and empty texts, and items of fewer
    words, match nothing. Items are sent to the executors in passes of at most about
    ``pass_characters`` characters, one scan of the documents each; a single larger item has its own.
    Repeated rows of a document add up; equal item ids are one item.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("item_id is not null and text is not null")
    size = items.select(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-size // pass_characters))
    rows = documents.select("doc_id", "text").where("text is not null")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id long, runs long"
    found = None
    for i in range(passes):
        some = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i)
        sent = documents.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in some.toLocalIterator()])
        part = rows.mapInArrow(lambda it, sent=sent, name=uuid.uuid4().hex: _search(it, sent, span, name), schema)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.sum("runs").alias("runs"))
