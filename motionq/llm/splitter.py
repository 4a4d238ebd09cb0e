"""Oversized texts cut at natural boundaries, all greedy cuts at once by pointer doubling.

Every token boundary of a text is a node; its successor is the farthest legal end of the piece that
starts ``overlap`` tokens before it. Squaring the successor table (``next[next]``) doubles the
number of pieces covered by a jump, so the nodes reached from the start, which are the cuts, are
found in a logarithmic number of whole-array steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionq.llm import bpe

LIMIT, OVERLAP = 512, 64
#: Ends of paragraphs, lines, sentences, words: the strongest kind is 4. A cut falls behind the match.
KINDS = (
    (4, regex.compile(r"\n[^\S\n]*\n\s*|</p>\s*")),
    (3, regex.compile(r"\n\s*|<br\s*/?>\s*")),
    (2, regex.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』）]*")),
    (1, regex.compile(r"\s+")),
)


def _inside(piece: str, enc: bpe.Encoder) -> tuple[int, ...]:
    """Character position in a piece at which each of its tokens starts, -1 inside a character."""
    ids = enc.piece(piece)
    if len(ids) == 1:
        return (0,)
    first = np.concatenate([[0], np.cumsum([enc.sizes[i] for i in ids])[:-1]])
    lead = (np.frombuffer(piece.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80
    return tuple(np.where(lead[first], np.cumsum(lead)[first] - 1, -1).tolist())


def token_starts(text: str, enc: bpe.Encoder) -> np.ndarray:
    """Character position at which each token starts, -1 for a token that starts inside a character."""
    out: list[int] = []
    seen = enc.__dict__.setdefault("starts", {})
    for m in enc.pattern.finditer(text):
        piece, at = m.group(), m.start()
        inside = seen.get(piece)
        if inside is None:
            inside = _inside(piece, enc)
            if len(piece) <= 64:
                if len(seen) >= bpe.REMEMBERED:
                    seen.clear()
                seen[piece] = inside
        if len(inside) == 1:
            out.append(at)
        else:
            out.extend([at + i if i >= 0 else -1 for i in inside])
    return np.array(out, int)


def strengths(text: str, starts: np.ndarray) -> np.ndarray:
    """Kind of each boundary ``0..n``: -1 inside a character, 0 plain, up to 4 for a paragraph end.

    A token that begins with the white space before a word follows a natural end too.
    """
    n = len(starts)
    out = np.where(np.append(starts, len(text)) >= 0, 0, -1)
    place = np.append(starts, len(text))
    good = np.flatnonzero(out >= 0)
    known = place[good]
    for kind, pattern in reversed(KINDS):
        spans = [(m.start() + (not text[m.start()].isspace()), m.end()) for m in pattern.finditer(text)]
        if spans:
            first, last = np.array(spans).T
            lo, hi = np.searchsorted(known, first), np.searchsorted(known, last, side="right")
            at = good[hi[hi > lo] - 1]
            out[at] = np.maximum(out[at], kind)
    out[0] = out[n] = 4
    return out


def cuts(kind: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) token of each piece of a text with boundaries ``kind``.

    From a cut, the piece reaches to the farthest boundary of the strongest kind in the latter half
    of what is allowed; without a natural one there, to the farthest natural boundary that makes more
    than a quarter of a piece, then to the farthest plain one. A start inside a character moves back to the one before it. Only where
    a single character has more tokens than fit is the limit kept by cutting inside it.
    """
    n = len(kind) - 1
    node = np.arange(n + 1)
    legal = kind >= 0
    back = np.maximum.accumulate(np.where(legal, node, 0))
    start = back[np.maximum(node - overlap, 0)]
    start = np.where((start + limit > node) & (node > 0), start, node)
    start[0] = 0
    far = np.minimum(start + limit, n)
    half = node + (far - node) // 2
    step = np.full(n + 1, -1)
    for least in (4, 3, 2, 1):
        last = np.maximum.accumulate(np.where(kind >= least, node, -1))[far]
        step = np.where((step < 0) & (last > half), last, step)
    for least, short in ((1, max(limit // 4, overlap)), (0, 0)):
        last = np.maximum.accumulate(np.where(kind >= least, node, -1))[far]
        step = np.where((step < 0) & (last > np.maximum(node, start + short)), last, step)
    step = np.where(step < 0, far, step)
    step[n] = n
    reached = np.zeros(n + 1, bool)
    reached[0] = True
    jump = step
    while True:  # after round r, the first 2**r cuts are marked
        more = reached.copy()
        more[jump[reached]] = True
        if np.array_equal(more, reached):
            break
        reached, jump = more, jump[jump]
    ends = np.flatnonzero(reached)
    return start[ends[:-1]], ends[1:]


def _fitting(text, kind, place, enc, limit, overlap):
    """Cuts whose pieces, encoded on their own, are within the limit: fewer tokens a piece where one came out longer."""
    most = limit
    while True:
        a, b = cuts(kind, most, overlap)
        over = max(len(enc.encode(text[place[x] : place[y]])) for x, y in zip(a, b, strict=True)) - limit
        if over <= 0 or most - over <= 2 * overlap:
            return a, b
        most -= over


def _split(batches, ranks, pattern, limit, overlap, with_text):
    enc = bpe.encoder(ranks.value, pattern)
    if not hasattr(enc, "sizes"):
        enc.sizes = {i: len(b) for b, i in enc.ranks.items()}
    for batch in batches:
        rows, number, first, last, texts = [], [], [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            if not text:
                continue
            if len(text.encode("utf-8", "surrogatepass")) <= limit:  # no more tokens than bytes
                a, b, place = [0], [len(enc.encode(text))], None
            else:
                starts = token_starts(text, enc)
                if len(starts) <= limit:
                    a, b, place = [0], [len(starts)], None
                else:
                    place = np.append(starts, len(text))
                    a, b = _fitting(text, strengths(text, starts), place, enc, limit, overlap)
            rows.extend([row] * len(a))
            number.extend(range(len(a)))
            first.extend(a)
            last.extend(b)
            if with_text:
                texts.extend([text] if place is None else [text[place[x] : place[y]] for x, y in zip(a, b, strict=True)])
        out = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(first, pa.int32()), pa.array(last, pa.int32())]
        yield pa.RecordBatch.from_arrays(out + [pa.array(texts, pa.string())] * with_text, names=["doc_id", "piece", "first_token", "last_token", "text"][: 4 + with_text])


def split(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, key: str = "doc_id", text: str = "text", rank_file: str = bpe.RANK_FILE, pattern: str = bpe.PATTERN) -> DataFrame:
    """``(doc_id, piece, first_token, last_token, text)``: ordered pieces of at most ``limit`` tokens.

    ``piece`` counts from 0; ``last_token`` is exclusive; a piece starts ``overlap`` tokens before the
    end of the one before (some more where that is inside a character). Pieces are within the limit also when encoded on
    their own, but for single characters beyond it. A text within the limit is
    one piece; an empty or null text has none. Needs ``0 <= overlap < limit / 2``. No shuffle.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be less than half of limit")
    ranks = documents.sparkSession.sparkContext.broadcast(bpe.read_ranks(rank_file))
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, first_token int, last_token int" + ", text string" * with_text
    return rows.mapInArrow(lambda it: _split(it, ranks, pattern, limit, overlap, with_text), schema)
