"""Secrets in texts: three fixed patterns, and tokens that pass a battery of randomness tests. Built-in functions only.

A candidate is a maximal run of 20 or more characters of an encoding's alphabet outside the spans of the fixed
patterns; ``=`` belongs to it as padding at its end alone, so the value of ``name=value`` is a run of its own. Its
encoding is inferred (decimal, hex, base32, base64 and its URL form), its characters become numbers, and three tests ask
whether they could be drawn uniformly: chi-squared over equal cells of the alphabet (for base64 halves of each case,
and the rest), Wald-Wolfowitz runs about the middle, lag-one serial correlation. The smallest of the three tail probabilities, times three, is the token's p.

Words and paths of ordinary text are far from uniform. How far a short one can be is limited, so the cut is made per
encoding and length band over all documents: made random tokens of the band give the share of p above each cut,
their largest number that the counts allow is the band's number of random tokens (two standard deviations of its
count are allowed for), and what exceeds them above a cut is called wrongly. The cut is the lowest at which at most
``FALSE_RATE`` of the called tokens are such excess; tokens at p up to ``LEAST_P`` are never called. The excess is a
least estimate: tokens whose p are spread like those of random ones cannot be told from them by any cut.

Defined cases: null and empty texts have no spans; repeated rows are scanned one by one; an empty table gives no
rows. Positions are code points, ends exclusive. Texts of any length are scanned whole; spans of
one start are ordered by kind; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import Store, prepared, read

# The patterns and least lengths of the three kinds.
KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6

RUN = r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "decimal": "0123456789",
}
CELLS = {"hex": 8, "base32": 8, "base64": 5, "decimal": 5}
BANDS = (32, 48, 80)
FALSE_RATE, LEAST_P = 0.01, 0.05
P_BINS = 26  # of minus log10 p times 20 from 0 on, down to LEAST_P: cuts are exact to a twentieth of a power of ten
MADE, SLACK = 2000, 2.0  # random tokens made per encoding and band; standard deviations allowed for
SPANS = "array<struct<start:int,kind:int,end:int>>"
CANDIDATES = "array<struct<start:int,end:int,stratum:int,p:double>>"


def _blocks(items: Column) -> Column:
    """An array as slices of its square root's length each: appending inside a slice copies that little."""
    size = F.greatest(F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int"), F.lit(1))
    return _bound(F.struct(items.alias("all"), size.alias("size")), lambda s: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(s["all"]) / s["size"]).cast("int") - 1, F.lit(0))),
        lambda block: F.slice(s["all"], block * s["size"] + 1, s["size"])))


def _before(values: Column, first: Column, join) -> Column:
    """For each value what ``join`` makes of all before it, ``first`` for the first."""
    return F.aggregate(values, F.array(first), lambda out, value: F.concat(out, F.array(join(F.element_at(out, -1), value))))


def _spans(text: Column, pattern: str, group: int = 0, least: int = 1) -> Column:
    """``array<struct<start, end, found>>`` of the leftmost non-overlapping matches whose ``group`` is long enough.

    Splitting at the matches gives the gaps between them; positions are running sums of gaps and matches, taken in
    blocks and over blocks: the work grows as the power 1.5 of the number of matches.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    lengths = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("len"),
                           F.transform(inner, F.length).alias("inner"), whole.alias("found"))
    kind = "array<struct<start:int,end:int,found:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(state: Column, item: Column) -> Column:
        begin = state["at"] + item["gap"]
        end = begin + item["len"]
        span = F.struct(begin.alias("start"), end.alias("end"), item["found"].alias("found"))
        out = F.when(item["inner"] >= least, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    def moved(blocks: Column, offsets: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda block, i: F.transform(block["out"], lambda s: F.struct(
            (s["start"] + offsets[i]).alias("start"), (s["end"] + offsets[i]).alias("end"), s["found"].alias("found")))))

    summed = F.transform(_blocks(lengths), lambda block: F.aggregate(block, start, step))
    return _bound(summed, lambda blocks: _bound(
        _before(F.transform(blocks, lambda block: block["at"]), F.lit(0), lambda x, y: x + y), lambda offsets: moved(blocks, offsets)))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))).cast(SPANS)


def base_spans(text: Column) -> Column:
    """All spans of the fixed patterns by start and kind. Each pattern runs only where a cheap test lets it."""
    none = F.array().cast(SPANS)
    assign = F.when(text.rlike(KEYWORD), _of_kind(_spans(text, ASSIGN, 2, LEAST_VALUE), 0)).otherwise(none)
    access = F.when(text.contains("AKIA"), _of_kind(_spans(text, ACCESS), 1)).otherwise(none)
    hexes = F.when(text.rlike(HEX), _of_kind(_spans(text, HEX), 2)).otherwise(none)
    return F.array_sort(F.concat(assign, access, hexes))


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by the logistic approximation (error below 0.0002)."""
    bounded = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(0.07056 * bounded * bounded * bounded + 1.5976 * bounded))


def _sum(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, item: total + term(item))


def _numbers(token: Column, alphabet: str) -> Column:
    return F.transform(F.split(token, ""), lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("double"))


def _bound(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def uniformity_p(token: Column, encoding: str) -> Column:
    """p of the battery for the characters of a token."""
    letters, cells = len(ALPHABETS[encoding]), CELLS[encoding]

    def counted(values: Column) -> Column:
        """What the tests need, each from one pass over the values."""
        high = F.transform(values, lambda v: (v >= letters / 2).cast("double"))
        later = F.slice(values, F.lit(2), F.size(values))
        changes = F.zip_with(high, F.slice(high, F.lit(2), F.size(high)), lambda a, b: F.abs(a - b))
        products = F.zip_with(values, later, lambda a, b: a * b)
        some = lambda items: _sum(F.filter(items, lambda d: d.isNotNull()), lambda d: d)
        return F.struct(F.size(values).cast("double").alias("n"), _sum(high, lambda v: v).alias("ones"), (1.0 + some(changes)).alias("runs"),
                        _sum(values, lambda v: v).alias("sum"), _sum(values, lambda v: v * v).alias("squares"), some(products).alias("products"),
                        (F.element_at(values, 1) + F.element_at(values, -1)).alias("ends"),
                        reduce(lambda x, y: x + y, [F.pow(in_cell(values, k), 2) for k in range(cells)]).alias("cells"))

    def in_cell(values: Column, k: int) -> Column:
        return F.size(F.filter(values, lambda v: F.floor(v * cells / letters) == k)).cast("double")

    def battery(c: Column) -> Column:
        n, free = c["n"], cells - 1
        chi = c["cells"] * cells / n - n
        # Wilson and Hilferty: the cube root of chi-squared over its freedom is close to normal.
        spread = 2.0 / (9 * free)
        chi_p = _normal_tail((F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - spread)) / spread ** 0.5)
        product = 2.0 * c["ones"] * (n - c["ones"])
        variance = product * (product - n) / (n * n * (n - 1))
        runs_p = F.when(variance > 0, 2.0 * _normal_tail(F.abs(c["runs"] - 1.0 - product / n) / F.sqrt(variance))).otherwise(F.lit(1e-9))
        # Sums of whole numbers are exact: a token of one letter has no squares left.
        squares = (c["squares"] * n - c["sum"] * c["sum"]) / n
        mean = c["sum"] / n
        products = c["products"] - mean * (2.0 * c["sum"] - c["ends"]) + (n - 1) * mean * mean
        serial_p = F.when(squares > 0, 2.0 * _normal_tail(F.abs(products / squares + 1.0 / n) * F.sqrt(n))).otherwise(F.lit(1e-9))
        return F.least(F.lit(1.0), 3.0 * F.least(chi_p, runs_p, serial_p))

    return _bound(_bound(_numbers(token, ALPHABETS[encoding]), counted), battery)


def _candidate(span: Column) -> Column:
    """One run as ``(start, end, stratum, p)``; the stratum numbers encoding and length band."""
    token = F.rtrim(F.translate(span["found"], "-_", "+/"), F.lit("="))
    is_hex = token.rlike(r"^([0-9a-f]+|[0-9A-F]+)$")
    is_base32 = token.rlike(r"^[A-Z2-7]+$")
    is_decimal = token.rlike(r"^[0-9]+$")
    p = (F.when(is_decimal, uniformity_p(token, "decimal"))
         .when(is_hex, uniformity_p(F.lower(token), "hex"))
         .when(is_base32, uniformity_p(token, "base32"))
         .otherwise(uniformity_p(token, "base64")))
    band = reduce(lambda a, b: a + b, [(F.length(token) >= bound).cast("int") for bound in BANDS])
    encoding = F.when(is_decimal, 3).when(is_hex, 0).when(is_base32, 1).otherwise(2)
    return F.struct(span["start"].alias("start"), span["end"].alias("end"),
                    (encoding * (len(BANDS) + 1) + band).cast("int").alias("stratum"), p.alias("p"))


def uncovered(text: Column, base: Column) -> Column:
    """The text with blanks in place of its base spans (sorted by start, they may overlap).

    The text is cut where blocks of spans begin, so a span's place is sought in its own piece alone.
    """
    empty = F.array().cast("array<string>")

    def piece(part: Column, block: Column, low: Column, covered: Column) -> Column:
        """A block's piece of the text, which begins at ``low``; earlier spans reach to ``covered``."""
        length = F.length(part)
        first = F.least(F.greatest(covered - low, F.lit(0)), length)
        start = F.struct(first.alias("at"), F.concat(empty, F.array(F.repeat(F.lit(" "), first))).alias("parts"))

        def step(state: Column, span: Column) -> Column:
            begin = F.least(F.greatest(span["start"] - low, state["at"]), length)
            end = F.least(F.greatest(span["end"] - low, state["at"]), length)
            parts = F.concat(state["parts"], F.array(F.substring(part, state["at"] + 1, begin - state["at"]), F.repeat(F.lit(" "), end - begin)))
            return F.struct(end.alias("at"), parts.alias("parts"))

        return F.aggregate(block, start, step, lambda state: F.concat(F.array_join(state["parts"], ""), F.substring(part, state["at"] + 1, length)))

    def cut(blocks: Column) -> Column:
        lows = F.concat(F.transform(blocks, lambda block: block[0]["start"]), F.array(F.length(text)))
        ends = F.transform(blocks, lambda block: F.array_max(F.transform(block, lambda span: span["end"])))
        return _bound(F.struct(lows.alias("low"), _before(ends, F.lit(0), F.greatest).alias("covered")), lambda c: F.concat(
            F.substring(text, F.lit(1), c["low"][0]), F.array_join(F.transform(blocks, lambda block, i: _bound(
                F.substring(text, c["low"][i] + 1, c["low"][i + 1] - c["low"][i]), lambda part: piece(part, block, c["low"][i], c["covered"][i]))), "")))

    return F.when(F.size(base) > 0, _bound(_blocks(base), cut)).otherwise(text)


def candidates(text: Column) -> Column:
    """Runs of an ``uncovered`` text with their p."""
    tested = F.transform(_spans(text, RUN), _candidate).cast(CANDIDATES)
    return F.when(text.rlike(RUN), tested).otherwise(F.array().cast(CANDIDATES))


def _bin(p: Column) -> Column:
    return F.floor(-20.0 * F.log10(F.greatest(p, F.lit(1e-30)))).cast("int")


def _made(spark: SparkSession) -> DataFrame:
    """``(stratum, p)`` of random tokens, the same in every run; lengths go evenly through each band."""
    bounds = (20, *BANDS, 2 * BANDS[-1])
    bands = len(bounds) - 1
    band = F.col("id") % bands
    least, most = (F.element_at(F.array(*map(F.lit, some)), band.cast("int") + 1) for some in (bounds[:-1], bounds[1:]))
    places = F.sequence(F.lit(1), (least + F.floor(F.col("id") / bands) % (most - least)).cast("int"))

    def one(number: int, encoding: str, alphabet: str) -> DataFrame:
        letter = lambda i: F.substring(F.lit(alphabet), F.pmod(F.xxhash64(F.lit(number), F.col("id"), i), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))
        tokens = spark.range(0, bands * MADE, 1, bands).select(
            (band + number * bands).cast("int").alias("stratum"), F.array_join(F.transform(places, letter), "").alias("token"))
        return tokens.select("stratum", uniformity_p(F.col("token"), encoding).alias("p"))

    return reduce(DataFrame.unionAll, [one(number, *kind) for number, kind in enumerate(ALPHABETS.items())])


def _by_bin(p: DataFrame) -> dict[int, list[int]]:
    """Per stratum how many ``p`` lie above the lower edge of each bin; at most one row per stratum and bin is collected."""
    counts: dict[int, list[int]] = {}
    called = p.filter(F.col("p") > LEAST_P).groupBy("stratum", _bin(F.col("p")).alias("bin")).agg(F.count("*").alias("n"))
    for row in called.collect():
        counts.setdefault(row["stratum"], [0] * (P_BINS + 1))[row["bin"]] = row["n"]
    return {stratum: list(accumulate(row)) for stratum, row in counts.items()}


def _cut(above: list[int], made: list[int]) -> int:
    """The number of bins, from p = 1 down, whose tokens are called."""
    shares = [max(n, 1) / MADE for n in made]
    # Upper limit of a count's mean; without any token above a cut, some random ones may still be below it.
    limits = [n + SLACK * SLACK / 2 + SLACK * math.sqrt(n + SLACK * SLACK / 4) for n in above]
    random = min(limit / share for limit, share in zip(limits, shares))
    return max((b + 1 for b, (n, share) in enumerate(zip(above, shares)) if n - random * share <= FALSE_RATE * n), default=0)


def thresholds(found: DataFrame) -> dict[int, int]:
    """Per stratum how many bins of p, from 1 down, count as random."""
    above = _by_bin(found.select(F.explode("candidates").alias("c")).select("c.stratum", "c.p"))
    made = _by_bin(_made(found.sparkSession)) if above else {}
    return {stratum: _cut(counts, made[stratum]) for stratum, counts in above.items()}


def scan(docs: DataFrame, store: Store) -> DataFrame:
    """``(doc_id, base, random)``: spans per row of ``docs``, stored, with the text left behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    based = docs.select("doc_id", text.alias("text")).withColumn("base", base_spans(F.col("text")))
    open_ = based.withColumn("text", uncovered(F.col("text"), F.col("base")))
    found = store.save(open_.withColumn("candidates", candidates(F.col("text"))).drop("text"), "found")
    cuts = thresholds(found)
    limits = F.create_map(*[F.lit(v) for pair in cuts.items() for v in pair]) if cuts else None

    def passes(c: Column) -> Column:
        cut = F.coalesce(limits[c["stratum"]], F.lit(0)) if cuts else F.lit(0)
        return (c["p"] > LEAST_P) & (_bin(c["p"]) < cut)

    return found.withColumn("random", _of_kind(F.filter("candidates", passes), 3)).drop("candidates")


def listing(spans: Column) -> Column:
    kind = F.array(*[F.lit(name) for name in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", kind[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4(spark, sf_dir: str) -> DataFrame:
    spark = prepared(spark)
    found = scan(read(spark, sf_dir, "documents"), Store(spark, "secrets"))

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", number(0), number(1), number(2), F.sha2(listing(F.col("base")), 256).alias("base_sha256"),
                        listing(F.concat("base", "random")).alias("spans"))
