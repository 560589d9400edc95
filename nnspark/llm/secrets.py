"""Secret scans: patterns plus sliding-window entropy, in SQL functions only (operator 9).

Base spans come from three patterns (``assign``, ``access``, ``hex``).  The entropy
scan adds spans of kind ``entropy``: every run of at least 20 characters
``[A-Za-z0-9+/_-]`` is a candidate, its character class (hex or mixed) sets a
threshold, and a window of 20 characters slides over it.  Each step of the slide
updates the character counts and the sum of c*log2(c) for the one character that
enters and the one that leaves; long candidates are slid over in blocks.  Overlapping windows above the threshold make one
span.  An allow-list drops candidates that are no secrets: UUIDs, runs without
letters and digits both, plain words joined by separators, placeholders.

Positions are found without any Python: ``split`` gives the text between matches,
``regexp_extract_all`` the matches, and their lengths are summed in two
levels of blocks, so a text with very many matches costs little more than
its length.  Offsets count code points, ends are exclusive.

Defined cases: a null text counts as empty; an empty text has no spans and the
hash of the empty string; repeated rows are scanned one by one; no row is dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns of the contract.
ASSIGN_KEY = r"((?i:password|passwd|secret|token|api_?key))"
ASSIGN_GLUE = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = ASSIGN_KEY + ASSIGN_GLUE + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# Runs that are long enough; a run of hex digits or of access-key characters is
# matched whole either way, so only the passing ones need to be looked for.
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
HEX_LONG = r"[0-9a-f]{24,}"
ASSIGN_MIN = 6

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
# Entropy in bits from which a window counts, per character class.
HEX_BITS, MIXED_BITS = 3.0, 3.5
# Allow-list: candidates that match one of these are no secrets.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    r"|^[^0-9]*$|^[^A-Za-z]*$|^[A-Za-z]++(?:[/_+-]++[A-Za-z]++)*+[/_+-]*[0-9]{0,4}$"
    r"|(?i:example|placeholder|changeme|xxxxx|abcdefgh|12345678)"
)
KINDS = ("assign", "access", "hex", "entropy")
BLOCK = 512
SLIDE = 256      # characters that one slide of the window goes over
FIRST_CODE, N_CODES = 32, 96
MASK = "[SECRET]"

FOUND = "array<struct<start:int,stop:int>>"
SPAN = "array<struct<start:int,rank:int,stop:int>>"


def _running(lengths: Column) -> Column:
    """Exclusive prefix sums of an array of ints, in blocks of ``BLOCK``."""
    n_blocks = F.ceil(F.size(lengths) / BLOCK).cast("int")
    blocks = F.when(n_blocks > 0, F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda k: F.slice(lengths, k * BLOCK + 1, F.lit(BLOCK))))
    blocks = F.coalesce(blocks, F.array().cast("array<array<int>>"))

    def scan(values: Column, start: Column) -> Column:
        zero = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, zero, lambda s, v: F.struct(
            (s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, v: s + v))
    return F.flatten(F.zip_with(blocks, scan(sums, F.lit(0)), lambda b, at: scan(b, at)))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, stop, part>> of the leftmost non-overlapping matches; part is ``group`` of the match."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
    steps = F.zip_with(gaps, whole, lambda g, m: F.length(g) + F.length(m))
    found = F.transform(
        F.arrays_zip(gaps.alias("g"), whole.alias("m"), part.alias("p"), _running(steps).alias("at")),
        lambda x: F.struct((x["at"] + F.length(x["g"])).alias("start"),
                           (x["at"] + F.length(x["g"]) + F.length(x["m"])).alias("stop"), x["p"].alias("part")))
    return F.when(text.rlike(pattern), found)


def _spans(found: Column, rank: int) -> Column:
    spans = F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop")))
    return F.coalesce(spans.cast(SPAN), F.array().cast(SPAN))


def threshold(candidate: Column) -> Column:
    """Bits a window of the candidate must reach; null for allow-listed candidates."""
    return F.when(candidate.rlike(ALLOW), F.lit(None).cast("double")).otherwise(
        F.when(candidate.rlike("^[0-9a-fA-F]+$"), F.lit(HEX_BITS)).otherwise(F.lit(MIXED_BITS)))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def _block_spans(block: Column, need: Column) -> Column:
    """Spans within one block of windows whose sum of c*log2(c) is at most ``need``."""
    # c * log2(c) of the counts a window can hold
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    zero = F.struct(F.array_repeat(F.lit(0), N_CODES).alias("counts"), F.lit(0.0).alias("sum"), F.array().cast(FOUND).alias("spans"))
    codes = F.transform(F.split(block, ""), lambda c: F.ascii(c) - FIRST_CODE + 1)

    def scan(codes: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            enters = F.element_at(codes, i)
            leaves = F.when(i > WINDOW, F.element_at(codes, i - WINDOW)).otherwise(F.lit(0))
            had, left = F.element_at(s["counts"], enters), F.when(i > WINDOW, F.element_at(s["counts"], F.greatest(leaves, F.lit(1))))
            term = lambda c: F.element_at(terms, c + 1)
            total = F.when(enters == leaves, s["sum"]).otherwise(
                s["sum"] + term(F.least(had + 1, F.lit(WINDOW))) - term(had)
                + F.when(i > WINDOW, term(F.greatest(left - 1, F.lit(0))) - term(left)).otherwise(F.lit(0.0)))
            counts = F.transform(s["counts"], lambda c, j: c + F.when(j + 1 == enters, 1).otherwise(0) - F.when(j + 1 == leaves, 1).otherwise(0))
            return F.struct(counts.alias("counts"), total.alias("sum"), grow(s["spans"], i, total).alias("spans"))

        def grow(spans: Column, i: Column, total: Column) -> Column:
            begin = (i - WINDOW).cast("int")
            new = F.struct(begin.alias("start"), i.cast("int").alias("stop"))
            last = F.element_at(spans, -1)
            grown = F.when((F.size(spans) > 0) & (begin <= F.coalesce(last["stop"], F.lit(-1))), F.concat(
                F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))),
                F.array(F.struct(last["start"].alias("start"), i.cast("int").alias("stop"))))).otherwise(
                F.concat(spans, F.array(new)))
            return F.when((i >= WINDOW) & (total <= need + 1e-9), grown).otherwise(spans)

        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step, lambda s: s["spans"])

    return _let(codes, scan)


def _merge(spans: Column) -> Column:
    """Sorted spans with those that touch made one."""
    def merge(x: Column) -> Column:
        near = lambda i: F.get(x, i)
        first = F.filter(x, lambda s, i: (i == 0) | (s["start"] > near(i - 1)["stop"]))
        last = F.filter(x, lambda s, i: (i == F.size(x) - 1) | (near(i + 1)["start"] > s["stop"]))
        return F.zip_with(first, last, lambda a, b: F.struct(a["start"].alias("start"), b["stop"].alias("stop")))

    return _let(spans, merge)


def hot_spans(candidate: Column) -> Column:
    """Spans (start, stop within the candidate) of windows whose entropy reaches the class's threshold.

    The windows slide within blocks of ``SLIDE`` characters, each with the ``WINDOW - 1`` characters before it, and
    the spans of neighbouring blocks are merged, so the work follows the candidate's length.
    """
    lead = WINDOW - 1
    need = (math.log2(WINDOW) - threshold(candidate)) * WINDOW

    def scan(x: Column) -> Column:
        def one(block: Column, i: Column) -> Column:
            before = F.when(i > 0, F.right(F.get(x["blocks"], i - 1), F.lit(lead))).otherwise(F.lit(""))
            at = F.greatest(i * SLIDE - lead, F.lit(0))
            return F.transform(_block_spans(F.concat(before, block), x["need"]), lambda s: F.struct(
                (at + s["start"]).cast("int").alias("start"), (at + s["stop"]).cast("int").alias("stop")))

        return F.when(x["need"].isNotNull(), _merge(F.flatten(F.transform(x["blocks"], one))))

    blocks = F.regexp_extract_all(candidate, F.lit("(?s).{1,%d}" % SLIDE), F.lit(0))
    return _let(F.struct(blocks.alias("blocks"), need.alias("need")), scan)


def _joined(spans: Column) -> Column:
    named = F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(named, ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_assign, n_access, n_hex, base_sha256, spans and n_entropy."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.filter(matches(text, ASSIGN, 2), lambda x: F.length(x["part"]) >= ASSIGN_MIN)
    found = docs.select(
        F.col(id_col).alias("id"), _spans(assign, 0).alias("assign"),
        _spans(F.when(F.contains(text, F.lit("AKIA")), matches(text, ACCESS_LONG)), 1).alias("access"),
        _spans(matches(text, HEX_LONG), 2).alias("hex"),
        matches(text, CANDIDATE).alias("candidates"))
    hot = F.flatten(F.transform(F.col("candidates"), lambda c: F.transform(
        F.coalesce(hot_spans(c["part"]), F.array().cast(FOUND)),
        lambda s: F.struct((c["start"] + s["start"]).alias("start"), F.lit(3).alias("rank"), (c["start"] + s["stop"]).alias("stop")))))
    entropy = F.coalesce(hot.cast(SPAN), F.array().cast(SPAN))
    base = F.array_sort(F.concat("assign", "access", "hex"))
    return found.select("id", "assign", "access", "hex", entropy.alias("entropy")).select(
        F.col("id").alias(id_col), F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("assign", "access", "hex", "entropy"))).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"))


def redact(text: Column) -> Column:
    """The text with every secret's value replaced by ``MASK``, kind after kind; null stays null.

    A text without secrets comes back unchanged.  Each kind splits the text at its
    matches and joins it again, so the cost follows the text's length.
    """
    def mask(t: Column, pattern: str, change) -> Column:
        whole = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        gaps = F.split(t, pattern, -1)
        parts = F.zip_with(F.slice(gaps, 1, F.size(whole)), whole, lambda g, m: F.concat(g, change(m)))
        return F.when(t.rlike(pattern), F.concat(F.array_join(parts, ""), F.element_at(gaps, -1))).otherwise(t)

    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    text = mask(text, ASSIGN, lambda m: F.when(F.length(value(m)) >= ASSIGN_MIN, F.concat(
        F.substring(m, F.lit(1), F.length(m) - F.length(value(m))), F.lit(MASK))).otherwise(m))
    for pattern in (ACCESS_LONG, HEX_LONG):
        text = mask(text, pattern, lambda m: F.lit(MASK))
    return mask(text, CANDIDATE, lambda m: F.when(F.size(F.coalesce(
        hot_spans(m), F.array().cast(FOUND))) > 0, F.lit(MASK)).otherwise(m))
