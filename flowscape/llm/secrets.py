"""Secret scan: key patterns plus sliding-window Shannon entropy, all in DataFrame functions.

Every whole text is scanned; null is the empty text.  Base kinds:

* ``assign``: a password-like name, ``=`` or ``:``, and a value of 8 or more characters;
* ``access``: ``AKIA`` and upper-case letters or digits, 16 or more characters in all;
* ``hex``: 32 or more lower-case hexadecimal digits.

Matches are leftmost and do not overlap within a kind; those that are too short are
dropped afterwards.  The entropy kind looks at candidate strings (runs of base64/hex
characters that hold a letter and a digit).  For each character class a window of
``window`` characters slides over the string; counts of the characters in the window are
updated by the one that enters and the one that leaves, and the sum of c*log2(c) with
them, so a step costs the same however wide the window is.  A candidate whose best
window reaches the threshold of its class becomes a span of kind ``entropy``, unless the
allow-list matches it.  Ties and repeated rows are scanned row by row; empty tables give
empty results; extra columns pass through untouched.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_text

# The patterns of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex")

#: What can't be a secret although it looks random: placeholders, UUIDs, one character repeated.
ALLOW = r"(?i)(example|sample|changeme|placeholder|lorem|dummy)|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^(.)\3+$"
#: Candidate runs; only those with a letter and a digit are scored.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Class -> (pattern the whole candidate fits, bits per character that make it suspicious).
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 2.9), ("alnum", r"^[A-Za-z0-9]+$", 3.6), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.7))
WINDOW = 20


def _pieces(text: Column, pattern: str, kind: str, keep) -> Column:
    """Spans of all leftmost non-overlapping matches: the pieces between them give the
    offsets, since piece and match lengths add up to the place in the text."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string,text:string>>").alias("out"))

    def step(acc, item):
        begin = acc["at"] + F.length(item["gap"])
        end = begin + F.length(item["hit"])
        span = F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("kind"), item["hit"].alias("text"))
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.when(item["hit"].isNotNull() & keep(item["hit"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    # zip_with evaluates both sides once; the last gap has no match and is kept out.
    pairs = F.zip_with(between, found, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    spans = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,text:string>>"))


def _hexes(text: Column) -> Column:
    """Runs of 32 or more hexadecimal digits.  A run is maximal, so looking for long runs
    directly finds the same spans as finding all runs and dropping the short ones."""
    return _pieces(text, r"[0-9a-f]{32,}", "hex", lambda hit: F.lit(True))


def base_spans(text: Column) -> Column:
    """Sorted array of struct(start, end, kind, text) of the three base kinds."""
    value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 8
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,text:string>>")
    # A plain search for the names comes first: it is far cheaper than the pattern.
    low = F.lower(text)
    named = reduce(or_, [F.contains(low, F.lit(name)) for name in NAMES])
    assign = F.when(named & text.rlike("[:=]"), _pieces(text, ASSIGN, "assign", value)).otherwise(empty)
    access = F.when(F.contains(text, F.lit("AKIA")), _pieces(text, ACCESS, "access", lambda hit: F.length(hit) >= 16)).otherwise(empty)
    hexes = F.when(text.rlike(r"[0-9a-f]{32}"), _hexes(text)).otherwise(empty)
    return F.concat(assign, access, hexes)


def _entropy(text: Column, window: int) -> Column:
    """Largest Shannon entropy (bits) of any window of the string, by incremental counts.

    The state maps a character's code to its count in the window; f(c) = c*log2(c) is
    summed incrementally and entropy = log2(n) - sum/n."""
    # A lambda's captured expression is evaluated at each call, so the split is bound first.
    return F.element_at(F.transform(F.array(F.split(text, "")), lambda chars: _slide(chars, window)), 1)


def _slide(chars: Column, window: int) -> Column:
    n = F.size(chars)
    f = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    zero = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def move(counts, s, code, by):
        old = F.get(counts, code)
        new = old + by
        return F.transform(counts, lambda c, j: F.when(j == code, new).otherwise(c)), s - f(old.cast("double")) + f(new.cast("double"))

    def step(acc, i):
        enter = F.ascii(F.get(chars, i))
        counts, s = move(acc["counts"], acc["s"], enter, 1)
        moved = F.struct(counts.alias("counts"), s.alias("s"))

        def leave(state):
            gone = F.ascii(F.get(chars, i - window))
            c2, s2 = move(state["counts"], state["s"], gone, -1)
            return F.struct(c2.alias("counts"), s2.alias("s"))

        after = F.transform(F.array(moved), lambda m: F.when(i >= window, leave(m)).otherwise(m))
        return F.element_at(
            F.transform(
                after,
                lambda m: F.struct(
                    m["counts"].alias("counts"),
                    m["s"].alias("s"),
                    F.when(i >= window - 1, F.greatest(acc["best"], F.log2(F.lit(float(window))) - m["s"] / window)).otherwise(acc["best"]).alias("best"),
                ),
            ),
            1,
        )

    return F.aggregate(F.sequence(F.lit(0), n - 1), zero, step, lambda acc: acc["best"])


def entropy_spans(text: Column, window: int = WINDOW, classes=CLASSES, allow: str = ALLOW) -> Column:
    """Spans of kind entropy over the whole text."""
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,text:string>>")
    found = _pieces(text, CANDIDATE, "entropy", lambda hit: hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & ~hit.rlike(allow))

    def suspicious(span):
        least = F.lit(None).cast("double")
        for _, pattern, bits in reversed(classes):
            least = F.when(span["text"].rlike(pattern), F.lit(bits)).otherwise(least)
        return _entropy(span["text"], window) >= least

    return F.when(text.rlike("[0-9]") & text.rlike(CANDIDATE), F.filter(found, suspicious)).otherwise(empty)


def scan_secrets(documents: DataFrame, text: str = "text", window: int = WINDOW, allow: str = ALLOW, base: str = "base_spans", spans: str = "secret_spans") -> DataFrame:
    """documents plus ``spans`` (base and entropy) and ``base``, both arrays of
    struct(start, end, kind, text) in code points, end exclusive, sorted by start, then kind.  A column that
    has one of these names already is an error: give another name."""
    if taken := {base.lower(), spans.lower()} & {c.lower() for c in documents.columns}:
        raise ValueError(f"columns exist: {sorted(taken)}")
    body = clean_text(text)
    order = lambda spans: F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, (*KINDS, "entropy"))), s["kind"]).alias("k"), s["end"], s["kind"], s["text"]))),
        lambda s: F.struct(s["start"], s["end"], s["kind"], s["text"]),
    )
    return documents.withColumn(base, order(base_spans(body))).withColumn(spans, order(F.concat(F.col(base), entropy_spans(body, window, allow=allow))))


def redact(documents: DataFrame, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """Replace every span by a mark; overlapping spans become one.  Other columns stay."""
    fresh = "_" * (1 + max((len(c) for c in documents.columns), default=0))  # longer than any name there is
    base, spans = fresh + "base", fresh + "spans"
    scanned = scan_secrets(documents, text, base=base, spans=spans)
    body = clean_text(text)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate(F.col(spans), zero, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    return scanned.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(F.col(text))).drop(base, spans)


def _digest(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scanned = scan_secrets(docs)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_digest(F.col("base_spans")), 256).alias("base_sha256"),
        _digest(F.col("secret_spans")).alias("spans"),
    )
