"""Substring de-duplication over sliding spans of sentences (operator 7).

A text is cut into sentences: after ``.``, ``!`` or ``?`` (or the Arabic, Hindi or other signs of ``_ENDS``) and white space, after
Chinese and Japanese ends, at line breaks, and before a word
that begins with a capital, as a passage pasted into running text starts inside another sentence.  Where ``WINDOW`` words in a row
hold none of these, the text is also cut before the word of lowest hash among them.  Such cuts depend on nothing outside their window, so two copies of a
passage agree on all cuts between the first and the last of the windows inside it.  These leave at most 13 words before the first common cut
and 13 after the last, so a passage of 51 words or more always holds an equal run of 25.  Characters of scripts
without spaces are words of their own to the cutting, and count as a part of a word (``_TENTHS``) in lengths;
for these the passage is as much longer.  The pieces between cuts are
called sentences from here on.

A span is a run of consecutive sentences, the shortest one of at least ``MIN_SENTENCES`` sentences and ``MIN_WORDS`` words that begins
at a sentence, and the shortest that ends at one; with both, a repeated passage is covered up to its last
sentence.  Every span's hash meets its equals over all documents.  The first (smallest document
id, then position) stays; the sentences of all others are removed.

Spans are hashed in ``mapInArrow`` and shuffled twice, once to count (combined map-side: a passage in a third of all
documents arrives as one row per task) and once to find the spans whose hash repeats, in a join whose
hot keys AQE can split.  Nothing is grouped by passage.  Hashes are XXH64 over the sentences in lower case, joined by line breaks.

Defined cases: null and empty texts have no sentences and come back as they are; case and white space
do not matter to equality; rows with one id and one text are one document and stay equal; rows with one id and different texts are
separate; a null id orders before all others.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnspark.llm.common import cut

MIN_SENTENCES = 2
MIN_WORDS = 25
# w words in a row without a cut leave w before the first common cut and w after the last: 51 - 2 * 13 = MIN_WORDS
WINDOW = 13
_ENDS = ".!?\u2026\u061f\u06d4\u0964\u0965\u0589\u1362\u1367\u104b\u17d4\u0f0d"
_WIDE_ENDS = "\u3002\uff01\uff1f\uff61"
# kinds of characters: white space, of words, wide ends, and scripts without spaces (Han and kana; Thai to Khmer)
_SPACE, _LETTER, _WIDE, _HAN, _THAI = range(5)
_SCRIPTS = ((0x3040, 0x30FF, _HAN), (0x3400, 0x4DBF, _HAN), (0x4E00, 0x9FFF, _HAN), (0xF900, 0xFAFF, _HAN), (0x20000, 0x3FFFE, _HAN),
            (0x0E00, 0x0FFF, _THAI), (0x1000, 0x109F, _THAI), (0x1780, 0x17FF, _THAI))
_TENTHS = np.array([0, 10, 0, 5, 2])  # the length of a word of each kind, in tenths
_SPAN_BITS = 20


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, is upper-case letter, is sentence end, hash in lower case) by code point; the last entry stands for all beyond."""
    n, letter = 0x40000, re.compile(r"[^\W\d_]")
    kind, upper, end, lower = np.full(n, _LETTER, np.uint8), np.zeros(n, bool), np.zeros(n, bool), np.arange(n, dtype=np.uint64)
    for lo, hi, k in _SCRIPTS:
        kind[lo:hi + 1] = k
    for c in range(0x20000):
        x = chr(c)
        if x.isspace():
            kind[c] = _SPACE
        elif x.isupper() and letter.match(x):
            upper[c] = True
        small = x.lower()
        if small != x and len(small) == 1:
            lower[c] = ord(small)
    end[[ord(x) for x in _ENDS]] = True
    kind[[ord(x) for x in _ENDS]] = _LETTER
    kind[[ord(x) for x in _WIDE_ENDS]] = _WIDE
    mixed = _mix(lower + np.uint64(1))
    mixed[kind == _SPACE] = 0
    return kind, upper, end, mixed


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


_KIND, _UPPER, _END, _MIXED = _tables()


def _lowest(values: np.ndarray) -> np.ndarray:
    """Places of the lowest value, the last among equals, of every ``WINDOW`` values (at most 2^31) in a row without a zero."""
    n = len(values)
    if n < WINDOW:
        return np.empty(0, np.int64)
    low, size = values << np.uint64(32) | np.arange(n, 0, -1).astype(np.uint64), 1
    while size < WINDOW:
        step = min(size, WINDOW - size)
        low, size = np.minimum(low[:-step], low[step:]), size + step
    low = low[low >> np.uint64(32) > 0]
    return n - (low & np.uint64((1 << 32) - 1)).astype(np.int64)


def _cuts(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, length in tenths of words) of the sentences, without the white space around them."""
    point = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(_KIND) - 1)
    kind = _KIND[point]
    full = np.zeros(len(kind) + 2, bool)
    full[1:-1] = kind != _SPACE
    dense = len(kind) > 0 and kind.max() > _LETTER
    edge = full[1:] != full[:-1]
    if dense:
        alone = kind > _LETTER
        between = (alone[1:] | alone[:-1]) & full[1:-2] & full[2:-1]
        begin, end = edge & full[1:], edge & full[:-1]
        begin[1:-1] |= between
        end[1:-1] |= between
        begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    else:
        edge = np.flatnonzero(edge)
        begin, end = edge[::2], edge[1::2]
    n = len(begin)
    if not n:
        return begin, end, begin
    last, next_ = point[end[:-1] - 1], point[begin[1:]]
    lines = np.flatnonzero(point == 10)
    real = _END[last] | _UPPER[next_]
    real[np.searchsorted(begin, lines[(lines > begin[0]) & (lines < begin[-1])]) - 1] = True
    if dense:
        real &= begin[1:] > end[:-1]
        real |= (_KIND[last] == _WIDE) & (_KIND[next_] != _WIDE)
    # the sum of a word's characters will do: equal words have equal hashes
    mixed = _mix(np.add.reduceat(_MIXED[point], begin)[1:]) >> np.uint64(33)
    mixed += np.uint64(1)
    mixed[real] = 0
    real[_lowest(mixed)] = True
    first = np.concatenate(([0], np.flatnonzero(real) + 1))
    after = np.concatenate((first[1:], [n]))
    return begin[first], end[after - 1], np.add.reduceat(_TENTHS[kind[begin]], first) if dense else 10 * (after - first)


def sentences(text: str) -> list[tuple[int, int]]:
    """(begin, end) of the sentences, without the white space around them."""
    lo, hi, _ = _cuts(text)
    return list(zip(lo.tolist(), hi.tolist()))


def spans(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of a text's spans; a position is first sentence << 20 | number of sentences."""
    import xxhash

    lo, hi, words = _cuts(text or "")
    n = len(lo)
    total, least = np.concatenate(([0], np.cumsum(words))), MIN_WORDS * 10
    if n < MIN_SENTENCES or total[-1] < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    parts = [" ".join(text[a:b].lower().split()) for a, b in zip(lo.tolist(), hi.tolist())]
    joined, place = "\n".join(parts), np.concatenate(([0], np.cumsum([len(x) + 1 for x in parts])))
    first = np.arange(n)
    stop = np.maximum(np.searchsorted(total, total[:-1] + least), first + MIN_SENTENCES)
    start = np.minimum(np.searchsorted(total, total[1:] - least, side="right") - 1, first + 1 - MIN_SENTENCES)
    ok, back = stop <= n, start >= 0
    at = np.concatenate((first[ok] << _SPAN_BITS | np.minimum(stop[ok] - first[ok], (1 << _SPAN_BITS) - 1),
                         start[back] << _SPAN_BITS | np.minimum(first[back] + 1 - start[back], (1 << _SPAN_BITS) - 1)))
    at = np.unique(at)
    mask = (1 << _SPAN_BITS) - 1
    begin, stop = place[at >> _SPAN_BITS], place[(at >> _SPAN_BITS) + (at & mask)] - 1
    found = (xxhash.xxh64_intdigest(joined[a:b]) for a, b in zip(begin.tolist(), stop.tolist()))
    return np.fromiter(found, np.uint64, len(at)).view(np.int64), at


def _rows(batches):
    import pyarrow as pa

    for batch in batches:
        hashes, at, row = [], [], []
        for i, text in enumerate(batch.column(2)):
            h, p = spans(text.as_py())
            hashes.append(h)
            at.append(p)
            row.append(np.full(len(h), i))
        take = pa.array(np.concatenate(row)) if row else pa.array([], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(hashes)) if hashes else pa.array([], pa.int64()), batch.column(0).take(take), batch.column(1).take(take),
             pa.array(np.concatenate(at)) if at else pa.array([], pa.int64())], names=["h", "id", "text_hash", "at"])


def all_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, id, text_hash, at) of every span of every text."""
    rows = docs.select(F.col(id_col).alias("id"), F.hash(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_rows, f"h bigint, id {dict(rows.dtypes)['id']}, text_hash int, at bigint")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, spans): per document the positions of its spans that are not the first of their kind."""
    place = F.struct("id", "text_hash", "at")
    # a written table, so that both sides of the join come from shuffles that AQE can split
    first, _ = cut(all_spans(docs, id_col, text_col).groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                   .filter("first != last").select("h", "first"), "spans-first")
    later = all_spans(docs, id_col, text_col).join(first, "h").filter(F.struct("id", "text_hash", "at") != F.col("first"))
    return later.groupBy("id", "text_hash").agg(F.collect_set("at").alias("spans"))


def _without(batches):
    import pyarrow as pa

    mask = (1 << _SPAN_BITS) - 1
    for batch in batches:
        texts, counts, gone, cuts_out = [], [], [], []
        for text, found in zip(batch.column(1), batch.column(2)):
            text, found = text.as_py(), found.as_py()
            cuts = _cuts(text or "")[:2]
            drop = np.zeros(len(cuts[0]) + 1, np.int64)
            for p in found or ():
                drop[p >> _SPAN_BITS] += 1
                drop[(p >> _SPAN_BITS) + (p & mask)] -= 1
            drop = np.cumsum(drop)[:-1] > 0
            if drop.any():
                edges = np.flatnonzero(np.diff(np.concatenate(([0], drop.view(np.int8), [0]))))
                ranges = list(zip(cuts[0][edges[::2]].tolist(), cuts[1][edges[1::2] - 1].tolist()))
                keep, at = [], 0
                for lo, hi in ranges:
                    keep.append(text[at:lo])
                    at = hi
                text = "".join([*keep, text[at:]]).strip()
                cuts_out.append(",".join(f"{lo}:{hi}" for lo, hi in ranges))
            else:
                cuts_out.append("")
            texts.append(text)
            counts.append(len(cuts[0]))
            gone.append(int(drop.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts_out, pa.string()), pa.array(texts, pa.string())],
            names=["id", "n_sentences", "n_removed", "removed", "text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_sentences, n_removed, removed (code point ranges begin:end) and the text without them."""
    found = repeated(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.hash(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    joined = (rows.alias("d").join(found.alias("f"), F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.text_hash") == F.col("f.text_hash")), "left")
              .select("d.id", "text", "spans"))
    kind = dict(rows.dtypes)["id"]
    return joined.mapInArrow(_without, f"id {kind}, n_sentences bigint, n_removed bigint, removed string, text string").select(
        F.col("id").alias(id_col), "n_sentences", "n_removed", "removed", "text")
