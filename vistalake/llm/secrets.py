"""Operator 9: secret scans by pattern and by sliding-window Shannon entropy, in DataFrame functions only.

Candidate strings are long runs of key-like characters. A window slides over each; of the counts of its
characters, two change with each step, and with them the sum of c*log2(c), which gives the window's
entropy. Each character class has its own threshold. An allow-list suppresses windows over placeholders,
and runs that are plain numbers or words.

All steps are linear in the text: running sums and maxima are taken in two levels of blocks, the counts
of a window fill a few 64-bit numbers, and texts are cut in blocks before parts of them are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm.shared import documents

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Runs that the entropy method looks at; (kind, pattern of the class, least entropy in bits) by class.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
CLASSES = (("hexadecimal", r"^[0-9A-Fa-f]+$", 2.8), ("base32", r"^[A-Z0-9]+=*$", 3.2), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.6))
#: Placeholders, in any case: no window that touches one counts.
PLACEHOLDERS = ("placeholder", "changeme", "example", "0000000", "1234567", "xxxx")
#: Suppressed runs: without a letter, or without a digit and of words (three characters or more for each change of case or sign).
NUMBERS, DIGIT, WORD = r"^[^A-Za-z]*$", r"[0-9]", r"[A-Z]?[a-z]+|[A-Z]+"
KINDS = ("assign", "access", "hex", "entropy")
_SPANS = "array<struct<start:int,kind:int,end:int,secret:string>>"
#: Characters of candidates; counts that a 64-bit number holds, with five bits for each; values of a block of running sums; characters of a block of text.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
PER_NUMBER, COUNT_BITS, BLOCK, TEXT_BLOCK = 12, 5, 64, 4096


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, zero: Column, both: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or maxima, by `both`) of an array, each with its own value: by blocks, then inside of blocks."""
    fold = lambda part: F.aggregate(part, zero, both)

    def of_blocks(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        totals = F.transform(blocks, lambda b: fold(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
        before = _bind(totals, lambda t: F.transform(blocks, lambda b: fold(F.slice(t, F.lit(1), b))))
        inside = lambda i: fold(F.slice(v, i - i % BLOCK + 1, i % BLOCK + 1))
        return _bind(before, lambda t: F.transform(v, lambda _, i: both(F.get(t, F.floor(i / BLOCK).cast("int")), inside(i))))

    return _bind(values, lambda v: F.when(F.size(v) > 0, of_blocks(v)).otherwise(v))


def _spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Code-point spans of all matches, left to right: what lies between matches and the matches themselves give the offsets."""
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secrets = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def found(pieces: Column) -> Column:
        ends = _running(F.transform(pieces, lambda x: F.length(x["gap"]) + F.length(x["hit"])), F.lit(0), lambda a, b: a + b)
        one = lambda x, end: F.struct((end - F.length(x["hit"])).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["secret"].alias("secret"))
        return F.zip_with(pieces, ends, one)

    pieces = _bind(hits, lambda h: F.arrays_zip(F.slice(between, F.lit(1), F.size(h)).alias("gap"), h.alias("hit"), secrets.alias("secret")))
    return F.when(text.rlike(pattern), _bind(pieces, found).cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def _dense(run: Column, least: Column) -> Column:
    """struct(first, last): 1-based ends of the first and last windows of `run` whose entropy reaches `least`; last 0 if none."""
    c_log_c = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    number_of = F.array(*[F.lit(ALPHABET.find(chr(k))) for k in range(128)])
    symbols = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.get(number_of, F.ascii(c)))
    cell = lambda s: F.floor(s / PER_NUMBER).cast("int")
    shift = lambda s: (s % PER_NUMBER * COUNT_BITS).cast("int")
    # For each character: which number holds its count and where, and the same for the one that leaves the window.
    at = lambda s, name: [cell(s).alias(f"{name}_cell"), shift(s).alias(f"{name}_shift")]
    steps = _bind(symbols, lambda v: F.transform(v, lambda s, i: _bind(F.get(v, i - WINDOW), lambda old: F.struct(*at(s, "in"), *at(old, "out"), (s == old).alias("same"), (i + 1).alias("i")))))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // PER_NUMBER)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    one = F.lit(1).cast("long")
    count = lambda counts, number, place: F.call_function("shiftright", F.get(counts, number), place).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

    def step(acc: Column, x: Column) -> Column:
        n = count(acc["counts"], x["in_cell"], x["in_shift"])
        more = F.get(c_log_c, n + 1) - F.get(c_log_c, n)
        m = count(acc["counts"], x["out_cell"], x["out_shift"]) + F.when(x["same"], 1).otherwise(0)
        less = F.when(x["out_cell"].isNotNull(), F.get(c_log_c, m - 1) - F.get(c_log_c, m)).otherwise(F.lit(0.0))
        change = lambda c, j: c + F.when(j == x["in_cell"], F.call_function("shiftleft", one, x["in_shift"])).otherwise(F.lit(0).cast("long")) - F.when(j == x["out_cell"], F.call_function("shiftleft", one, x["out_shift"])).otherwise(F.lit(0).cast("long"))
        counts = F.transform(acc["counts"], change)

        def judged(total: Column) -> Column:
            hit = (x["i"] >= WINDOW) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= least - F.lit(1e-9))
            return F.struct(counts.alias("counts"), total.alias("sum"), F.when(hit & (acc["first"] == 0), x["i"]).otherwise(acc["first"]).alias("first"), F.when(hit, x["i"]).otherwise(acc["last"]).alias("last"))

        return _bind(acc["sum"] + more + less, judged)

    return F.aggregate(steps, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _entropy_spans(text: Column) -> Column:
    plain = text
    for word in PLACEHOLDERS:
        plain = F.regexp_replace(plain, f"(?i){word}", " " * len(word))
    runs = _spans(plain, CANDIDATE, KINDS.index("entropy"))
    least = lambda run: F.coalesce(*[F.when(run.rlike(p), F.lit(h)) for _, p, h in CLASSES])
    words = lambda run: ~run.rlike(DIGIT) & (F.length(run) >= 3 * F.size(F.regexp_extract_all(run, F.lit(WORD), F.lit(0))))
    kept = F.filter(runs, lambda x: ~x["secret"].rlike(NUMBERS) & ~words(x["secret"]))
    dense = lambda x: _bind(least(x["secret"]), lambda bar: _dense(x["secret"], bar))
    judged = F.transform(kept, lambda x: F.struct(x.alias("run"), dense(x).alias("dense")))
    found = F.transform(F.filter(judged, lambda x: x["dense"]["last"] > 0), lambda x: F.struct(
        (x["run"]["start"] + x["dense"]["first"] - WINDOW).alias("start"), x["run"]["kind"].alias("kind"),
        (x["run"]["start"] + x["dense"]["last"]).alias("end"), x["run"]["secret"].alias("secret"))).cast(_SPANS)
    return F.when(text.rlike(CANDIDATE), found).otherwise(F.array().cast(_SPANS))


def _without_held(spans: Column) -> Column:
    """Spans in order, without entropy spans that another kind's span holds."""
    entropy = F.lit(KINDS.index("entropy"))

    def kept(v: Column) -> Column:
        ends = F.transform(v, lambda x: F.when(x["kind"] == entropy, F.lit(0)).otherwise(x["end"]))
        return _bind(_running(ends, F.lit(0), lambda a, b: F.greatest(a, b)), lambda far: F.filter(v, lambda x, i: (x["kind"] != entropy) | (F.get(far, i) < x["end"])))

    return F.when(F.exists(spans, lambda x: x["kind"] == entropy), _bind(spans, kept)).otherwise(spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with `_base` and `_all`: arrays of spans (start, kind number, end, secret) in order of start, then kind.

    Offsets are code points, ends exclusive, of whole matches. Null and empty texts have no spans,
    repeated rows have each their own, an empty table gives no rows. Entropy spans that a pattern's span
    holds are left out. Every other column stays; `_base` and `_all` of the input, if any, are replaced.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("_base", "_all")]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    text = F.col("text")
    assign = F.filter(_spans(text, ASSIGN, 0, 1), lambda x: F.length(x["secret"]) >= 12)
    out = packed.select("row", "text", F.array_sort(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2))).alias("base"))
    out = out.select("row", "base", F.array_sort(F.concat("base", _entropy_spans(text))).alias("every"))
    return out.select("row.*", F.col("base").alias("_base"), _without_held(F.col("every")).alias("_all"))


def _part(blocks: Column, start: Column, end: Column) -> Column:
    """Characters start to end of a text in blocks of TEXT_BLOCK."""
    first = F.floor(start / TEXT_BLOCK).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, F.floor(end / TEXT_BLOCK).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(near, start - first * TEXT_BLOCK + 1, end - start)).otherwise(F.lit(""))


def _masked(text: Column, spans: Column, mask: str) -> Column:
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))

    def joined(b: Column, v: Column, far: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(far, i - 1)).otherwise(F.lit(0))
        parts = F.transform(v, lambda x, i: F.when((i == 0) | (x["start"] >= before(i)), F.concat(_part(b, before(i), x["start"]), F.lit(mask))).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), _part(b, F.element_at(far, -1), F.length(text)))

    far = _running(F.transform(spans, lambda x: x["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
    return _bind(blocks, lambda b: _bind(far, lambda f: joined(b, spans, f)))


def redact_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """Columns of `docs`, with every secret span of `text` replaced by `mask` and n_chars, where there is one, recounted.

    Overlapping spans are masked once; texts without secrets, nulls included, stay as they are.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = scan_secrets(packed).select("row", "_all", F.when(F.size("_all") > 0, _masked(F.col("text"), F.col("_all"), mask)).alias("clean"))
    row = F.col("row").withField("text", F.col("clean"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("clean").cast(docs.schema["n_chars"].dataType))
    return found.select(F.when(F.size("_all") > 0, row).otherwise(F.col("row")).alias("row")).select("row.*")


def _joined(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("_base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("_all").alias("spans"))
