"""Phrase collocation mining by best-first branch-and-bound growth.

Per language, a phrase of 2 to ``longest`` words with at least ``least`` occurrences scores
floor(1000 a n / (l r)) at its worst cut; the best ``top`` scores among the phrases that no longer
phrase of the same count contains are wanted.

Method: nodes are phrases, grown word by word to the right. Cutting a grown phrase after its first
word gives a / r <= 1, so nothing below a node scores more than floor(1000 n / f(first word)):
the node's bound. The frontier is expanded best bound first. As an expansion reads the texts,
nodes are taken in waves: first the best-bounded words that hold half of all occurrences, which
sets the incumbent (the ``top``-th score that survives); then, wave by wave, every open node whose
bound still reaches the incumbent. A candidate's score also needs counts of suffixes, which
may start at words never expanded: while its bound from the counts known reaches the incumbent,
the missing ones are counted in the next wave by name. Nodes and candidates below the
incumbent are left for good; all that ties with it is settled. The loop ends when no open node and
no unsettled candidate reaches it.

A longer phrase of equal count contains one that is longer by a single word, so a phrase is dropped
when all its occurrences have the same next (or the same previous) word: smallest and largest hash
of the neighbours are summed along with the counts.

Scale: a wave is one read of the texts; tasks count grams in numpy over chunks of ``CHUNK`` words, Spark
sums them with map-side combine, so hot words and phrases weigh nothing. Which nodes to
expand reaches the tasks as bitmaps of bounded size, whose mistakes only add rows that are dropped
later; the frequent words themselves go along while they are at most ``DICTIONARY``, and the texts are
then split and numbered by them once, so that waves read numbers. Counts, frontier and scores are tables; the best of a language are found in two steps, so
none is sorted in one task. Scores use decimals of 36 digits.

Defined cases: null or empty texts have no words, a null language is ``und``; repeated rows count
each; texts of any length are read in pieces; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerscope.llm.bitmaps import bitmap, bitmaps
from answerscope.llm.common import plain_text, segments, slices, stored

LEAST, LONGEST, TOP = 100, 5, 2000
UNKNOWN = "und"
CHUNK = 1_000_000  # words counted at a time
ROW = 1 << 16  # numbered words kept in a row
DICTIONARY = 500_000  # frequent words sent to the tasks as such; beyond, each chunk numbers its own
DISTINCT = 500_000  # words held by a task's first count
SHARDS = 256  # of a language, when its best are found

_BREAK = b"\xff"  # no byte of UTF-8
_CUT = bytes(255 if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_digest = xxhash.xxh64_intdigest


def words_of(text: str):
    """Lists of a text's words, with a break between pieces."""
    for part in segments(text.encode().translate(_CUT).replace(_BREAK, b" \xff ")):
        yield part.split()


def _words(batches):
    """Word counts: (lang, phrase, c)."""
    held: dict[str, Counter] = defaultdict(Counter)

    def flush():
        for lang, counts in held.items():
            counts.pop(_BREAK, None)
            names = pa.array(list(counts), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(names), pa.string()), "phrase": names, "c": pa.array(list(counts.values()), pa.int64())})
        held.clear()

    for batch in slices(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for part in words_of(text):
                held[lang].update(part)
        if sum(map(len, held.values())) > DISTINCT:
            yield from flush()
    yield from flush()


class _Names(dict):
    """Numbers for the words of a chunk; 0 is the break, and with a fixed list every word outside it.

    No phrase holds a rare word, and rare neighbours are never all the same: they may pass for breaks.
    """

    def __init__(self, fixed: list[bytes] | None = None):
        self.list = [_BREAK, *(fixed or ())]
        self.fixed = fixed is not None
        self.kept: tuple | None = None
        super().__init__((w, i) for i, w in enumerate(self.list))

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.list)
        self.list.append(word)
        return number

    @property
    def width(self):
        """The type that numbers of a fixed list are kept in."""
        return np.uint16 if len(self.list) <= 1 << 16 else np.int32

    def numbers(self, words: list[bytes]) -> np.ndarray:
        found = map(self.get, words, repeat(0)) if self.fixed else map(self.__getitem__, words)
        return np.fromiter(found, np.int32, len(words))

    def keyed(self, lang: str, wave: Wave) -> tuple:
        """(words, keys, marks, frequent, grow, on): what a wave asks of single words; once a task for a fixed list."""
        if self.kept is None:
            seed = _digest(lang, 42)
            keys = np.array([_digest(w, seed) for w in self.list], np.uint64)
            marks = keys.view(np.int64).copy()
            marks[0] = 0
            frequent, grow = wave.words.has(keys), wave.grow.has(keys)
            on = grow | wave.via.has(keys)
            frequent[0] = on[0] = False
            found = pa.array(self.list, pa.binary()), keys, marks, frequent, grow, on
            if not self.fixed:
                return found
            self.kept = found
        return self.kept


class Wave:
    """What a wave counts: extensions of ``grow``, phrases ``asked`` for by name; ``via`` holds their beginnings."""

    def __init__(self, grow, via, asked, words, lengths: set[int], longest: int, dictionary: dict[str, list[bytes]] | None = None):
        """``words``: the frequent ones; ``dictionary``: the same as lists by language, if they are few."""
        self.grow, self.via, self.asked, self.words, self.lengths, self.longest, self.dictionary = grow, via, asked, words, lengths, longest, dictionary


def _grams(ids: np.ndarray, at: np.ndarray, names: _Names, lang: str, wave: Wave):
    """Counts of the wave's phrases that start at the given positions, a batch for each length."""
    seed, size = _digest(lang, 42), len(names.list)
    words, keys, marks, frequent, grow, on = names.keyed(lang, wave)
    padded = np.concatenate((np.zeros(1, np.int32), ids, np.zeros(wave.longest + 1, np.int32)))
    phrases = words
    gram = ids[at].astype(np.int64)
    for length in range(1, wave.longest):
        if length > 1:
            grow = wave.grow.has(keys)
            on = grow | wave.via.has(keys)
        following = padded[1 + at + length]
        use = on[gram] & frequent[following]
        at, key = at[use], gram[use] * size + following[use]
        if not len(at):
            return
        order = np.argsort(key)
        at, key = at[order], key[order]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        times = np.diff(np.append(head, len(key)))
        parent, last = np.divmod(key[head], size)
        phrases = pc.binary_join_element_wise(phrases.take(pa.array(parent)), words.take(pa.array(last)), _SPACE)
        told = grow[parent]
        deeper = length + 1 in wave.lengths
        if deeper:
            keys = np.array([_digest(p, seed) for p in phrases.to_pylist()], np.uint64)
            told |= wave.asked.has(keys)
        if told.any():
            after, before = marks[padded[2 + at + length]], marks[padded[at]]
            ends = {"nlo": np.minimum.reduceat(after, head), "nhi": np.maximum.reduceat(after, head), "plo": np.minimum.reduceat(before, head), "phi": np.maximum.reduceat(before, head)}
            n = int(told.sum())
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([lang] * n, pa.string()), "phrase": phrases.filter(pa.array(told)).cast(pa.string()), "c": times[told]}
                | {k: v[told] for k, v in ends.items()}
            )
        if not deeper:
            return
        gram = np.repeat(np.arange(len(head)), times)


_SPACE = pa.scalar(b" ", pa.binary())
COUNTED = "lang string, phrase string, c long, nlo long, nhi long, plo long, phi long"


def _chunks(batches, dictionary: dict[str, list[bytes]] | None, longest: int, size: int):
    """(lang, names, ids, first, stop): numbered words in chunks of about ``size``; phrases start from ``first``
    up to ``stop``. A chunk that ends inside a text hands on its last words."""
    names: dict[str, _Names] = {}
    held: dict[str, list] = defaultdict(list)
    context: dict[str, int] = defaultdict(int)
    count = 0

    def flush(going: str | None):
        for lang in list(held):
            ids, own = np.concatenate(held[lang]), names[lang]
            if lang == going and len(ids) <= longest + 1:
                continue  # too few words to tell where the next chunk starts
            first, stop, rest = context[lang], len(ids), []
            if lang == going:
                stop = len(ids) - longest
                rest = [own.list[i] for i in ids[stop - 1 :].tolist()]
            yield lang, own, ids, first, stop
            del held[lang], context[lang]
            if not own.fixed:
                del names[lang]
            if rest:
                put(lang, rest)
                context[lang] = 1

    def put(lang: str, words: list[bytes]) -> None:
        if lang not in names:
            names[lang] = _Names(None if dictionary is None else dictionary[lang])
        held[lang].append(names[lang].numbers(words))

    for batch in slices(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if dictionary is not None and lang not in dictionary:
                continue
            for part in words_of(text):
                put(lang, part)
                count += len(part)
                if count >= size:
                    yield from flush(lang)
                    count = 0
            put(lang, [_BREAK])
    yield from flush(None)


NUMBERED = "lang string, first int, stop int, ids binary"


def _numbered(broadcast, longest: int):
    """The texts as numbers of frequent words, some texts a row; ``_read`` takes them up again."""

    def run(batches):
        for lang, names, ids, first, stop in _chunks(batches, broadcast.value, longest, ROW):
            yield pa.RecordBatch.from_pydict(
                {"lang": [lang], "first": pa.array([first], pa.int32()), "stop": pa.array([stop], pa.int32()), "ids": pa.array([ids.astype(names.width).tobytes()], pa.binary())}
            )

    return run


def _read(batches, dictionary: dict[str, list[bytes]], size: int):
    """(lang, names, ids, at): the rows of ``_numbered`` in chunks of about ``size`` words, a break after each row."""
    names: dict[str, _Names] = {}
    held, at = defaultdict(list), defaultdict(list)
    length: dict[str, int] = defaultdict(int)
    gap = np.zeros(1, np.uint16)

    def flush():
        for lang, ids in held.items():
            yield lang, names[lang], np.concatenate(ids), np.concatenate(at[lang])
        for x in (held, at, length):
            x.clear()

    for batch in slices(batches, "ids"):
        for lang, first, stop, raw in zip(*(batch.column(c).to_pylist() for c in ("lang", "first", "stop", "ids"))):
            if lang not in names:
                names[lang] = _Names(dictionary[lang])
            ids = np.frombuffer(raw, names[lang].width)
            held[lang] += [ids, gap]
            at[lang].append(np.arange(first, stop) + length[lang])
            length[lang] += len(ids) + 1
            if sum(length.values()) >= size:
                yield from flush()
    yield from flush()


def _counts(broadcast, numbered: bool = False):
    """Counts over chunks of the partition, of texts or of the rows of ``_numbered``."""

    def run(batches):
        wave = broadcast.value
        if numbered:
            chunks = _read(batches, wave.dictionary, CHUNK)
        else:
            texts = _chunks(batches, wave.dictionary, wave.longest, CHUNK)
            chunks = ((lang, names, ids, np.arange(first, stop)) for lang, names, ids, first, stop in texts)
        for lang, names, ids, at in chunks:
            yield from _grams(ids, at, names, lang, wave)

    return run


GROW, VIA, ASKED = range(3)


def _wanted(grow: DataFrame, asked: DataFrame) -> DataFrame:
    """(lang, phrase, m, role): what a wave grows and asks for, and all proper beginnings of it."""
    both = grow.withColumn("role", F.lit(GROW)).unionByName(asked.withColumn("role", F.lit(ASKED)))
    parts = both.filter("m > 1").select("lang", "phrase", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    via = parts.select("lang", F.array_join(F.slice(F.split("phrase", " "), 1, F.col("k")), " ").alias("phrase"), F.col("k").alias("m"))
    return both.unionByName(via.distinct().withColumn("role", F.lit(VIA)))


def _whole(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(15,0)")


def _ratio(above: Column, below: Column) -> Column:
    """floor(above / below) of exact decimals."""
    return F.call_function("div", above, below)


def _best(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their ``rank``, in two steps."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    shard = F.pmod(F.xxhash64("phrase"), F.lit(SHARDS)).alias("shard")
    some = scored.select("*", shard).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "shard").orderBy(*order)))
    return some.filter(F.col("rank") <= top).drop("shard").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def _first_cut(nodes: DataFrame) -> DataFrame:
    """(lang, cut): the bound down to which the best-bounded words hold half of all occurrences."""
    bins = nodes.groupBy("lang", F.floor(F.log2(F.col("bound") + 1) * 4).alias("bin")).agg(F.sum("f").alias("mass"), F.min("bound").alias("least"))
    above = Window.partitionBy("lang").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("lang")
    told = bins.select("*", F.coalesce(F.sum("mass").over(above), F.lit(0)).alias("before"), F.sum("mass").over(all_).alias("whole"))
    return told.filter("2 * before < whole").groupBy("lang").agg(F.min("least").alias("cut"))


def _judged(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Every candidate with its worst cut among the known ones: best (score, k, l, r), ``limit`` (what it can
    score at most) and the parts that are still to be counted."""
    parts = F.split("phrase", " ")
    k = F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")
    cuts = candidates.select("*", k).select(
        "*", F.array_join(F.slice(parts, 1, F.col("k")), " ").alias("left"), F.array_join(F.slice(parts, F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("right")
    )
    counts = known.select("lang", "phrase", "f")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"], "left")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"], "left")
    a, n = F.lit(1000).cast("decimal(4,0)") * _whole("a"), _whole("n")
    score = _ratio(a * n, _whole("l") * _whole("r"))
    alone = F.expr("1000 * n div coalesce(l, r, 1)")  # the other part occurs a times at least
    missing = lambda count, part, m: F.when(F.col(count).isNull(), F.struct(F.col(part).alias("phrase"), m.cast("int").alias("m")))
    return cuts.groupBy("lang", "phrase", "m", "a", "n", "bound").agg(
        F.min(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), F.struct(score.alias("score"), "k", "l", "r"))).alias("best"),
        F.min(F.coalesce(score, alone)).alias("limit"),
        F.array_compact(F.concat(F.collect_list(missing("l", "left", F.col("k"))), F.collect_list(missing("r", "right", F.col("m") - F.col("k"))))).alias("missing"),
    )


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP,
    most_words: int = DICTIONARY,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language."""
    rows = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), plain_text(text).alias("text"))
    sc = docs.sparkSession.sparkContext
    counts = stored(rows.mapInArrow(_words, "lang string, phrase string, c long").groupBy("lang", "phrase").agg(F.sum("c").alias("f")), "words")
    total = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = stored(counts.filter(F.col("f") >= least).join(total, "lang").withColumn("bound", F.expr("1000 * n div f")).withColumn("m", F.lit(1)), "nodes")
    key = F.xxhash64("lang", "phrase")
    frequent = bitmap(words, key)
    dictionary = None
    if words.count() <= most_words:
        dictionary = {}
        for r in words.select("lang", "phrase").collect():
            dictionary.setdefault(r["lang"], []).append(r["phrase"].encode())
        # split into words and numbered once, not in each wave
        rows = stored(rows.mapInArrow(_numbered(sc.broadcast(dictionary), longest), NUMBERED), "numbered")
    known = words.select("lang", "phrase", "f")
    firsts = words.select("lang", F.col("phrase").alias("first"), "n", "bound")
    node = ["lang", "phrase", "m", "bound"]
    first = words.join(_first_cut(words), "lang")  # the first wave, and what it leaves open
    grow, open_ = first.filter("bound >= cut").select(node), first.filter("bound < cut").select(node)
    settled = waiting = None
    asked = grow.select("lang", "phrase", "m").limit(0)
    while True:
        wanted = stored(_wanted(grow.select("lang", "phrase", "m"), asked), "wanted")
        deepest = wanted.agg(F.max("m")).first()[0]
        if deepest is None:
            break
        wave = Wave(*bitmaps(wanted, key, F.col("role"), 3), frequent, set(range(2, deepest + 1)), longest, dictionary)
        summed = rows.mapInArrow(_counts(sc.broadcast(wave), dictionary is not None), COUNTED).groupBy("lang", "phrase").agg(
            F.sum("c").alias("f"), F.min("nlo").alias("nlo"), F.max("nhi").alias("nhi"), F.min("plo").alias("plo"), F.max("phi").alias("phi")
        )
        m = F.size(F.split("phrase", " "))
        only = lambda lo, hi: (F.col(lo) == F.col(hi)) & (F.col(lo) != 0)
        closed = (m == longest) | ~(only("nlo", "nhi") | only("plo", "phi"))
        again = summed.filter(F.col("f") >= least).select("lang", "phrase", "f", m.alias("m"), closed.alias("closed"))
        new = again.join(known, ["lang", "phrase"], "left_anti").withColumn("first", F.substring_index("phrase", " ", 1)).join(firsts, ["lang", "first"])
        fresh = stored(new.select("lang", "phrase", "m", "f", "closed", "n", "bound"), "nodes")
        known = known.unionByName(fresh.select("lang", "phrase", "f"))
        # a phrase that is not closed needs no score
        candidates = fresh.filter("closed").select("lang", "phrase", "m", F.col("f").alias("a"), "n", "bound")
        if waiting is not None:
            candidates = candidates.join(incumbent, "lang", "left").filter("bound >= coalesce(incumbent, 0)").drop("incumbent").unionByName(waiting)
        judged = stored(_judged(candidates, known), "judged")
        done = judged.filter(F.size("missing") == 0).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
        settled = stored(_best(done if settled is None else settled.unionByName(done), top), "best").drop("rank")
        last = settled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("incumbent"))
        incumbent = last.filter(F.col("n") == top).select("lang", "incumbent")  # of languages that have so many
        reaching = lambda rows, limit: rows.join(incumbent, "lang", "left").filter(F.col(limit) >= F.coalesce("incumbent", F.lit(0))).drop("incumbent")
        later = stored(reaching(judged.filter(F.size("missing") > 0), "limit"), "waiting")
        waiting = later.select("lang", "phrase", "m", "a", "n", "bound")
        asked = later.select("lang", F.explode("missing").alias("x")).select("lang", "x.*").distinct()
        open_ = reaching(open_, "bound")
        grow = open_.unionByName(reaching(fresh.filter(F.col("m") < longest).select(node), "bound"))
        open_ = open_.limit(0)
    if settled is None:
        return words.select("lang", F.lit(0).cast("long").alias("rank"), "phrase", F.col("f").alias("a"), F.col("f").alias("l"), F.col("f").alias("r"), "n", F.col("f").alias("score")).limit(0)
    return _best(settled, top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
