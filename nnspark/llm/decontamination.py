"""Benchmark decontamination with a generalised suffix automaton (operator 8).

The normalised words of the test items build one suffix automaton over words per
block of items.  Document words stream through it: the state and the longest matching
length after each word say whether a window (``window`` consecutive item words,
or a whole item that is shorter) ends there, and which items hold it.  Words inside a
window's occurrence are hit.

Items are the small side.  Their text is measured; up to ``MAX_ITEM_BYTES`` it is
read in blocks of ``BLOCK_BYTES``, each broadcast as text, and each task builds a block's
automaton once.  More than that raises instead of filling the driver.  Documents
pass through one ``mapInArrow`` without a shuffle.  With several blocks they are written once with a row number
and pass through one block's automaton after the other, so that a task holds one; the hits meet by row number.

Runs of words that no item holds are skipped with one dictionary look-up per word:
a window lies within a run of item words, so only runs that are long enough are
matched, and skipping the rest changes nothing.

Defined cases: null and empty texts have no words and are not contaminated; items
without words are ignored; the words of an item with a null id are hit, but it names no item; repeated items count once; repeated documents are judged
one by one; without items nothing is hit.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnspark.llm.common import TAG, cut, tag_rows

WINDOW = 13
MAX_ITEM_BYTES = 256 << 20
BLOCK_BYTES = 1 << 20
PIECE = 4 << 20

# Separators become spaces and A-Z lower case; bytes from 0x80 belong to words.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Automaton:
    """Suffix automaton of word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for item, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        #: items that hold the strings of a state; whole short items by state
        self.items: list[set[str]] = [set() for _ in self.next]
        self.short: dict[int, dict[int, set[str]]] = {}
        for item, codes in coded:
            state = 0
            for c in codes:
                state = up = self.next[state][c]
                while up > 0 and item not in self.items[up]:
                    self.items[up].add(item)
                    up = self.link[up]
            if len(codes) < window:
                self.short.setdefault(state, {}).setdefault(len(codes), set()).add(item)
        self.shortest = min((min(len(codes), window) for _, codes in coded), default=0)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.has_short = bytearray(len(self.next))
        for s in order:
            self.has_short[s] = s in self.short or self.has_short[self.link[s]]

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def codes(self, text: str | None) -> np.ndarray:
        """The text's words as item-vocabulary codes (-1: in no item), in pieces of bounded memory."""
        if not text:
            return np.empty(0, np.int32)
        raw = text.encode("utf-8", "surrogatepass").translate(_TABLE)
        parts, at, get = [], 0, self.vocab.get
        while at < len(raw):
            to = raw.rfind(b" ", at, at + PIECE) if at + PIECE < len(raw) else len(raw)
            if to <= at:
                to = raw.find(b" ", at + 1)
                to = len(raw) if to < 0 else to
            words = raw[at:to].split()
            parts.append(np.fromiter((get(w, -1) for w in words), np.int32, len(words)))
            at = to
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def match(self, codes: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit spans (word positions, end exclusive) and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if not self.shortest:
            return spans, found
        known = np.concatenate(([0], (codes >= 0).view(np.int8), [0]))
        edges = np.flatnonzero(np.diff(known))
        begins, ends = edges[::2], edges[1::2]
        long = ends - begins >= self.shortest
        for b, e in zip(begins[long].tolist(), ends[long].tolist()):
            self._walk(codes[b:e].tolist(), b, spans, found)
        merged: list[tuple[int, int]] = []
        for lo, hi in sorted(spans):
            if merged and lo <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
            else:
                merged.append((lo, hi))
        return merged, found

    def _walk(self, run: list[int], base: int, spans: list, found: set) -> None:
        nxt, link, length, window, has_short = self.next, self.link, self.length, self.window, self.has_short
        state = size = 0
        for i, c in enumerate(run, base + 1):
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(c)
            if to is None:
                continue
            state, size = to, size + 1
            if size >= window:
                up = state
                while length[link[up]] >= window:
                    up = link[up]
                found |= self.items[up]
                if spans and spans[-1][1] >= i - window:
                    spans[-1] = (min(spans[-1][0], i - window), max(spans[-1][1], i))
                else:
                    spans.append((i - window, i))
            if has_short[state]:
                up = state
                while up > 0:
                    for n, items in self.short.get(up, {}).items():
                        if n <= size:
                            found |= items
                            spans.append((i - n, i))
                    up = link[up]


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                max_bytes: int = MAX_ITEM_BYTES, block_bytes: int = BLOCK_BYTES) -> list[list[tuple[str, str]]]:
    """The items' ids and texts on the driver, after their size was checked, in blocks of bounded size."""
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).dropna(subset="text").distinct()
    need = rows.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("id"), F.lit(0)))).first()[0] or 0
    if need > max_bytes:
        raise ValueError(f"benchmark items hold {need} bytes, more than max_bytes={max_bytes}")
    blocks: list[list[tuple[str, str]]] = []
    size = block_bytes
    for row in rows.orderBy("id", "text").toLocalIterator():
        if size >= block_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append((row["id"], row["text"]))
        size += len(row["text"])
    return blocks


_FIELDS = [("n_words", "bigint"), ("spans", "array<struct<start:bigint,stop:bigint>>"), ("items", "array<string>")]


def _kernel(block, window):
    def make():
        import pyarrow as pa

        automaton = Automaton([(item, words_of(text)) for item, text in block.value], window)
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

        def kernel(texts):
            counts, spans, items = [], [], []
            for scalar in texts:
                codes = automaton.codes(scalar.as_py())
                hit, found = automaton.match(codes)
                counts.append(len(codes))
                spans.append([{"start": lo, "stop": hi} for lo, hi in hit])
                items.append(sorted(i for i in found if i is not None))
            return [pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))]

        return kernel

    return make


def tag_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW,
                      cols: list[str] | None = None, **blocks) -> DataFrame:
    """``docs`` plus struct ``TAG``: n_words, spans (merged hit word spans) and items (ids with an occurring window)."""
    sc = docs.sparkSession.sparkContext
    cols = list(docs.columns) if cols is None else list(cols)
    parts = item_blocks(items, **blocks) or [[]]
    if len(parts) == 1:
        return tag_rows(docs, text_col, _kernel(sc.broadcast(parts[0]), window), _FIELDS, cols)
    # one block of items after the other, so that a task holds one automaton
    names = list(docs.columns)
    stored, _ = cut(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
                                F.monotonically_increasing_id().alias("row")), "items-documents")
    found = None
    for part in parts:
        tagged = tag_rows(stored, f"c{names.index(text_col)}", _kernel(sc.broadcast(part), window), _FIELDS, ["row"])
        if found is not None:
            tagged = tagged.filter(F.size(f"{TAG}.spans") > 0)
        hits, _ = cut(tagged.select("row", f"{TAG}.*"), "items-hits")
        found = hits if found is None else found.unionByName(hits)
    merged = found.groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    tag = F.struct("n_words", _merge(F.col("spans")).alias("spans"), "items").alias(TAG)
    return stored.join(merged, "row").select(*[F.col(f"c{names.index(c)}").alias(c) for c in cols], tag)


def _merge(spans):
    """Union of sorted spans."""
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def step(done, s):
        last = F.element_at(done, -1)
        longer = F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop")))
        return F.when((F.size(done) > 0) & (s["start"] <= F.coalesce(last["stop"], F.lit(-1))),
                      F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), longer)).otherwise(
            F.concat(done, F.array(s)))

    return F.aggregate(spans, empty, step)


def n_hit():
    return F.aggregate(F.col(f"{TAG}.spans"), F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def contaminated():
    """The contract's rule: some word is hit, and at least one word in twenty."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col(f"{TAG}.n_words"))


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    tagged = tag_contamination(docs.select(id_col, text_col), items, text_col, cols=[id_col], **options)
    return tagged.select(
        id_col, F.col(f"{TAG}.n_words").alias("n_words"), n_hit().alias("n_hit"),
        F.size(f"{TAG}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{TAG}.items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Documents whose coverage keeps within the limit, unchanged."""
    return tag_contamination(docs, items, text_col, **options).filter(~contaminated()).select(*docs.columns)


def remove_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", min_words: int = WINDOW,
                 min_coverage: float = 0.0, **options) -> DataFrame:
    """Documents with hit spans of at least ``min_words`` words cut from the text.

    Only texts whose hit words reach ``min_coverage`` of all words are changed.
    """
    tagged = tag_contamination(docs, items, text_col, **options)
    long = F.filter(f"{TAG}.spans", lambda s: s["stop"] - s["start"] >= min_words)
    wanted = F.when((F.size(long) > 0) & (n_hit() >= min_coverage * F.col(f"{TAG}.n_words")), long)
    names = list(docs.columns)
    packed = tagged.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], wanted.alias("cut"))
    at = names.index(text_col)

    def run(batches):
        import re

        import pyarrow as pa

        word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        for batch in batches:
            texts = []
            for text, spans in zip(batch.columns[at].to_pylist(), batch.columns[-1].to_pylist()):
                if spans:
                    # lower-casing A-Z moves no offset, so places are found in the lower-cased text
                    places = [m.span() for m in word.finditer(text.translate({c: c + 32 for c in range(65, 91)}))]
                    for s in reversed(spans):
                        text = text[:places[s["start"]][0]] + text[places[s["stop"] - 1][1]:]
                texts.append(text)
            columns = [*batch.columns[:-1]]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(names))])

    out = packed.mapInArrow(run, packed.drop("cut").schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
