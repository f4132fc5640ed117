"""Secret scan: fixed patterns, and a randomness test battery under false-discovery control.

Base kinds (leftmost, not overlapping within a kind): ``assign``, ``access``, ``hex``. Beside
them every run of at least ``LEAST`` encoding characters is a candidate. Its encoding is
inferred (the smallest alphabet that holds all its characters) and three tests ask whether it
could be uniformly random over that alphabet: chi-squared on symbol counts, runs above and
below the middle of the alphabet, and serial correlation of neighbouring symbols. Their
smallest p-value, corrected for three looks, is uniform for random strings and near zero for
words, paths and numbers in order.

False-discovery control by evidence: how many times likelier a string is when drawn uniformly over
its alphabet than when spelled like the words of the corpus (pairs of neighbouring symbols in
words of fewer than ``LEAST`` symbols that several documents hold, each word once; keys are neither). Every
symbol adds to it, so short strings prove little. Such a ratio averages at most one over strings
spelled like words, hence the e-value form of the Benjamini-Hochberg rule holds for any mix of strings, be
there one key or a million: with m strings, those of at least 2^b stay where they are at least m / (``FDR`` 2^b).
Strings that the battery rejects at ``REJECT`` have no evidence; distinct strings count once, so
copies neither make nor break a cutoff. Strings over it become spans of kind ``random`` unless
they meet a base span, which always stays.

All of it is built-in column expressions: one pass over the words, whose 63 x 63 pair counts go back
as a literal, one scan that leaves (id, spans, candidates), and a histogram of at most 201 rows.

Defined cases: null or empty text has no span; repeated rows get equal answers; an empty
table has an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.llm.common import id_key, plain_text, stored

#: The base patterns. The length demands of the last two are part of the pattern,
#: which finds the same spans since neither can begin inside a shorter match of its kind.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

LEAST = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Alphabets by name, the smallest first; values of symbols are their places.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
FDR, REJECT, MOST = 0.1, 0.01, 200  # evidence beyond 2^MOST counts as 2^MOST
#: Symbols of the word model by place; 0 is a word's border, which each of + / _ - can be.
SYMBOLS = UPPER + LOWER + DIGITS
PRIOR, SCALE = 8, 256  # weight of single symbols in a pair's probability; steps to a bit
CHUNK = 256


def _found(pattern: str, rank: int, least_value: int = 0) -> Column:
    """The spans of a pattern in ``text``, in order, as structs (start, rank, end, value).

    The gaps between matches and the matches themselves, both in order, give the places.
    """
    gaps, hits = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all("text", F.lit(pattern), F.lit(2)) if least_value else hits
    parts = F.arrays_zip(gaps.alias("g"), hits.alias("h"), values.alias("v"))
    kind = "struct<start:bigint,rank:int,end:bigint,value:string>"

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["g"])
        end = start + F.length(part["h"])
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), part["v"].alias("value"))
        fits = F.length(part["v"]) >= least_value  # null for what follows the last match
        return F.struct(F.coalesce(end, start).alias("at"), F.when(fits, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    # appending copies what is there: short lists are filled, then joined
    count = F.ceil(F.size(parts) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(1), count), lambda k: F.slice(parts, (k - 1) * CHUNK + 1, CHUNK))
    whole = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))

    def chunk(acc: Column, some: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return _with(F.aggregate(some, start, step), lambda one: F.struct(one["at"].alias("at"), F.concat(acc["out"], F.array(one["out"])).alias("out")))

    spans = F.aggregate(chunks, whole, chunk, lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(hits) > 0, spans).otherwise(F.array().cast(f"array<{kind}>"))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by the usual rational approximation (error below 1e-7)."""
    x = F.abs(z) / F.lit(2**0.5)
    t = 1 / (1 + F.lit(0.3275911) * x)
    series = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    half = series * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def encoding(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, alphabet in reversed(ENCODINGS.items()):
        # what is left once the alphabet's characters are taken away
        out = F.when(F.translate(token, alphabet, "") == "", F.lit(name)).otherwise(out)
    return out


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def randomness(token: Column, enc: Column) -> Column:
    """The battery's p-value: uniform on 0 to 1 for strings that are random over their alphabet."""
    alphabet = F.element_at(F.create_map(*[F.lit(x) for pair in ENCODINGS.items() for x in pair]), enc)
    place = lambda c: F.position(c, alphabet).cast("double") - 1
    values = F.transform(F.split(token, ""), place)
    return _with(values, lambda v: _battery(v, F.length(alphabet).cast("double")))


def _battery(values: Column, size: Column) -> Column:
    n = F.size(values).cast("double")
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))
    # neighbours: (sum over pairs, pair before) as the accumulator
    begin = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("x"))

    def neighbours(xs: Column, f) -> Column:
        step = lambda acc, x: F.struct((acc["s"] + F.coalesce(f(acc["x"], x), F.lit(0.0))).alias("s"), x.alias("x"))
        return F.aggregate(xs, begin, step, lambda acc: acc["s"])

    # symbols in stretches of the alphabet, so many that about five fall into each
    cells = F.greatest(F.lit(2.0), F.least(size, F.floor(n / 5).cast("double")))

    def deviation(cell: Column) -> Column:
        low, high = F.ceil(cell * size / cells), F.ceil((cell + 1) * size / cells)
        seen = F.size(F.filter(values, lambda v: (v >= low) & (v < high))).cast("double")
        return seen * seen * size / (n * (high - low))

    chi = total(F.sequence(F.lit(0), cells.cast("int") - 1), deviation) - n
    df = cells - 1
    spread = F.lit(2.0) / (9 * df)
    uniform = _upper_tail((F.cbrt(chi / df) - (1 - spread)) / F.sqrt(spread))

    is_high = lambda v: (v >= size / 2).cast("double")
    turned = 1 + neighbours(values, lambda a, b: F.abs(is_high(a) - is_high(b)))

    def runs(up: Column) -> Column:
        mean = 2 * up * (n - up) / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        return F.when(var > 0, 2 * _upper_tail(F.abs(turned - mean) / F.sqrt(var))).otherwise(0.0)

    def serial(centre: Column) -> Column:
        square = total(values, lambda v: (v - centre) * (v - centre))
        lagged = neighbours(values, lambda a, b: (a - centre) * (b - centre))
        return F.when(square > 0, 2 * _upper_tail(F.abs(lagged / square + 1 / n) * F.sqrt(n))).otherwise(0.0)

    tests = F.least(uniform, _with(total(values, is_high), runs), _with(total(values, lambda v: v) / n, serial))
    return 1 - F.pow(1 - tests, F.lit(3.0))


def spelling(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[int]:
    """What each pair of neighbouring symbols costs in words, in steps of a bit: row by row, 63 x 63.

    Words are runs of letters and digits, shorter than a candidate and held by two documents or more.
    """
    words = docs.select(id_key(doc_id).alias("id"), F.explode(F.regexp_extract_all(plain_text(text), F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("word"))
    seen = words.filter(F.length("word") < LEAST).groupBy("word").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b")
    bordered = F.concat(F.lit(" "), "word", F.lit(" "))
    pairs = seen.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substr(bordered, i, F.lit(2)))).alias("pair"))
    size = len(SYMBOLS) + 1
    counts = [[0] * size for _ in range(size)]
    for row in pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect():
        a, b = (SYMBOLS.find(c) + 1 for c in row["pair"])
        counts[a][b] = row["n"]
    before, after = [sum(r) for r in counts], [sum(c) for c in zip(*counts)]
    single = [(n + 1) / (sum(before) + size) for n in after]
    cost = lambda a, b: math.floor(-SCALE * math.log2((counts[a][b] + PRIOR * single[b]) / (before[a] + PRIOR)))
    # a border is one of four characters: two bits more
    return [cost(a, b) + (0 if b else 2 * SCALE) for a in range(size) for b in range(size)]


def evidence(token: Column, enc: Column, costs: list[int]) -> Column:
    """Bits for a uniform draw over the encoding against the spelling of words, 0 to ``MOST``.

    Three bits pay for the choice among eight encodings; all rounding is downwards.
    """
    table = F.split(F.lit(",".join(map(str, costs))), ",").cast("array<int>")  # folded into one literal
    uniform = F.create_map(*[F.lit(x) for name, letters in ENCODINGS.items() for x in (name, math.ceil(SCALE * math.log2(len(letters))))])
    places = F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(SYMBOLS)))
    begin = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).alias("a"))
    step = lambda acc, b: F.struct((acc["s"] + F.get(table, acc["a"] * (len(SYMBOLS) + 1) + b)).alias("s"), b.alias("a"))
    spelled_out = F.aggregate(places, begin, step, lambda acc: acc["s"])
    bits = F.floor((spelled_out - F.length(token) * F.element_at(uniform, enc)) / SCALE) - 3
    return F.greatest(F.lit(0), F.least(F.lit(MOST), bits)).cast("int")


def scan(docs: DataFrame, costs: list[int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, candidates) of every row: sorted base spans; candidate runs with their evidence, 0 if the battery rejects."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), plain_text(text).alias("text"))
    found = rows.select(
        "doc_id",
        F.array_sort(F.concat(_found(ASSIGN, 0, 6), _found(ACCESS, 1), _found(HEX, 2))).alias("base"),
        _found(CANDIDATE, 3).alias("runs"),
    )
    free = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    coded = F.transform(free, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["value"].alias("value"), encoding(r["value"]).alias("enc")))
    tested = F.transform(
        F.filter(coded, lambda r: r["enc"].isNotNull()),
        lambda r: F.struct(
            r["start"].alias("start"), r["end"].alias("end"), F.xxhash64(r["value"]).alias("token"),
            F.when(randomness(r["value"], r["enc"]) >= REJECT, evidence(r["value"], r["enc"], costs)).otherwise(0).alias("bits"),
        ),
    )
    slim = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["rank"].alias("rank"), b["end"].alias("end")))
    return found.select("doc_id", slim.alias("base"), tested.alias("candidates"))


def cutoff(found: DataFrame, fdr: float = FDR) -> int | None:
    """The least bits of evidence reported; None if no string has enough."""
    tokens = found.select(F.explode("candidates").alias("c")).select("c.token", "c.bits").distinct()
    counts = {row["bits"]: row["n"] for row in tokens.groupBy("bits").agg(F.count(F.lit(1)).alias("n")).collect()}
    told, lowest = 0, None
    for b in range(MOST, 0, -1):
        told += counts.get(b, 0)
        if told * 2.0**b * fdr >= sum(counts.values()) and told:
            lowest = b
    return lowest


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fdr: float = FDR) -> DataFrame:
    """(doc_id, base, added): base spans (start, rank, end) in order, and the battery's spans."""
    found = stored(scan(docs, spelling(docs, doc_id, text), doc_id, text), "secrets")
    least = cutoff(found, fdr)
    chosen = F.filter("candidates", lambda c: c["bits"] >= (MOST + 1 if least is None else least))
    added = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), c["end"].alias("end")))
    return found.select("doc_id", "base", added.alias("added"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")
