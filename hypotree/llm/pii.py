"""Personal data: base patterns, and identifiers of other forms found by bootstrapping from the contexts of the base's finds.

What the base patterns find are seeds. The words beside them make lexical patterns: one or two tokens on the left, or on the
right. Spark scores the graph of patterns and instances (the different strings seen beside them) in rounds: a pattern is as
sure as the share of its occurrences, over the whole corpus, that are known identifiers of a kind; an instance is as sure as
its patterns, the best of either side taken together. Instances sure enough count as known in the next round. What is found
so are strings that look like an identifier but match no base pattern: numbers without a country code or a check digit,
addresses with a part too high or in hexadecimal, mail addresses written in other ways.

A null text is the empty text. Every row is treated as a document of its own, repeated ids and rows included; the same string
counts once as an instance, however often it is repeated. Extra columns take no part; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE, map_texts, slices, write_table

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]++")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_RUN = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Strings that may be identifiers though no base pattern has them.
_NUMBER = re.compile(r"(?<!\w)[+(]?[0-9]++(?:[ ().:/-]{1,2}[0-9]++)*+")
_COLONS = re.compile(r"(?<![\w:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![\w:])")
_NAME = re.compile(r"[^\s@<>()\[\]{}\"',;:|]{1,64}")
_WRITTEN_AT = re.compile(r" ?[\[({]at[\])}] ?", re.IGNORECASE)
_WRITTEN_HOST = re.compile(r"[\w-]{1,64}(?: ?(?:\.|[\[({](?:dot|punkt|punto|point)[\])}]) ?[\w-]{1,64}){1,8}", re.IGNORECASE)

_TOKEN = re.compile(r"\w+|[^\w\s]")
#: Characters beside a find that are looked at for tokens, and the longest token that makes a pattern.
_BESIDE, _LONGEST = 96, 40
#: Places of a find's context: the tokens next to it on the left, on the right.
SLOTS = ("left1", "left2", "right1", "right2")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back to where its name begins, not before the last match's end: each character is looked at a few times only."""
    at = text.find("@")
    if at < 0:
        return
    back, n, bound = text[::-1], len(text), 0
    while at >= 0:
        name = _LOCAL.match(back, n - at, n - bound)
        host = _DOMAIN.match(text, at) if name else None
        if host:
            bound = host.end()
            yield at - (name.end() - name.start()), bound
        at = text.find("@", max(bound, at + 1))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for chain in _CHAIN.finditer(text):
        parts = chain.group().split(".") if chain.end() - chain.start() >= 7 else ()
        at = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for run in _RUN.finditer(text):
        if run.end() - run.start() >= 12:
            digits = run.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield run.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, found.group())) <= 15:
            yield found.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns' matches, leftmost and not overlapping within a kind, by start and kind. Linear in the text."""
    return sorted((a, k, b) for k, finder in enumerate((_emails, _addresses, _cards, _phones)) for a, b in finder(text))


def _looks_like(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, kinds it may be of, as bits) of strings that look like identifiers."""
    for found in _NUMBER.finditer(text):
        a, b = found.span()
        if b - a < 6 or b < len(text) and (text[b] == "_" or text[b].isalnum()):
            continue
        group = found.group()
        digits = sum(map(str.isdigit, group))
        kinds = 8 * (6 <= digits <= 15) + 4 * (12 <= digits <= 24) + 2 * (group.count(".") >= 3 and not group.strip("0123456789."))
        if kinds:
            yield a, b, kinds
    if ":" in text:
        for found in _COLONS.finditer(text):
            if len(found.group()) >= 6:
                yield *found.span(), 2
    at, back = text.find("@"), None
    while at >= 0:
        back = text[::-1] if back is None else back
        name, host = _NAME.match(back, len(text) - at), _NAME.match(text, at + 1)
        if name and host:
            yield at - (name.end() - name.start()), host.end() - len(host.group()) + len(host.group().rstrip(".!?")), 1
        at = text.find("@", at + 1)
    if "at" in text or "AT" in text:
        for mark in _WRITTEN_AT.finditer(text):
            back = text[::-1] if back is None else back
            name, host = _LOCAL.match(back, len(text) - mark.start(), len(text) - max(0, mark.start() - 64)), _WRITTEN_HOST.match(text, mark.end())
            if name and host:
                yield mark.start() - (name.end() - name.start()), host.end(), 1


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kinds as bits) of strings that look like identifiers, none overlapping another or the base's; earlier ones first, then longer ones."""
    out, taken, k, free = [], [], 0, 0
    for a, _, b in base:  # the base's spans as one ascending list
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    for a, b, kinds in sorted(set(_looks_like(text)), key=lambda x: (x[0], -x[1], -x[2])):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a >= free and b > a and (k == len(taken) or taken[k][0] >= b):
            out.append((a, b, kinds))
            free = b
    return out


_MASK = (1 << 64) - 1
_FIRST, _SECOND, _PLUS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def token_hash(token: str) -> int:
    """64 bits for a token, whatever its case; 0 for one too long for a pattern."""
    return xxhash.xxh64_intdigest(token.lower().encode()) or 1 if len(token) <= _LONGEST else 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _grams(one: int, two: int) -> int | None:
    return _signed((one * _FIRST + two * _SECOND + _PLUS) & _MASK) if one and two else None


def context(text: str, start: int, end: int) -> list[int | None]:
    """Hashes of the one and two tokens before and after a span, in the order of SLOTS; null where there is none."""
    a, b = max(0, start - _BESIDE), min(len(text), end + _BESIDE)
    left, right = _TOKEN.findall(text, a, start), _TOKEN.findall(text, end, b)
    word = lambda i: text[i] == "_" or text[i].isalnum()
    if left and a and word(a - 1) and word(a):
        left = left[1:]  # cut off by the limit
    if right and b < len(text) and word(b - 1) and word(b):
        right = right[:-1]
    hl, hr = [token_hash(t) for t in left[-2:]], [token_hash(t) for t in right[:2]]
    one = [_signed(h[i]) if h and h[i] else None for h, i in ((hl, -1), (hr, 0))]
    two = [_grams(*h) if len(h) == 2 else None for h in (hl, hr)]
    return [one[0], two[0], one[1], two[1]]


_MENTION = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kinds", T.IntegerType()), T.StructField("value", T.LongType()), T.StructField("context", T.ArrayType(T.LongType()))])


def mentions(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, mentions): each document's base finds (kind: its number) and candidates (kind: null), with the kinds that they may be of, as bits, a hash of the string, and context()."""
    schema = T.StructType([docs.schema[key], T.StructField("mentions", T.ArrayType(_MENTION))])

    def told(text: str) -> list[dict]:
        base = base_spans(text)
        found = [(a, k, b, 1 << k) for a, k, b in base] + [(a, None, b, kinds) for a, b, kinds in candidates(text, base)]
        return [{"start": a, "kind": k, "end": b, "kinds": kinds, "value": _signed(xxhash.xxh64_intdigest(text[a:b].lower().encode())), "context": context(text, a, b)} for a, k, b, kinds in found]

    arrow = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("kinds", pa.int32()), ("value", pa.int64()), ("context", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, SLICE):
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array([told(t or "") for t in part.column(text).to_pylist()], arrow)], schema.fieldNames())

    return map_texts(docs.select(key, text), run, schema)


class _Hashes(dict):
    """Token hashes, each worked out once; emptied beyond a bound, which changes only the speed."""

    def __missing__(self, token: str) -> int:
        self[token] = found = token_hash(token)
        return found


def occurrences(docs: DataFrame, grams: DataFrame, *, text: str = "text", log_words: int = 18) -> DataFrame:
    """(gram, n): how often each gram (one token or two in a row) of the given ones occurs in all texts.

    The grams go to the tasks as bits of a Bloom filter of fixed size (2^log_words words of 64 bits); what passes it is counted in the task, over all
    its texts, then by Spark, and a join leaves the given grams only.
    """
    n_words = 1 << log_words
    place = F.shiftrightunsigned("gram", 6).bitwiseAND(n_words - 1)
    marked = grams.groupBy(place.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(gram & 63 as int))")).alias("bits")).toArrow()  # at most n_words rows
    words = np.zeros(n_words, np.int64)
    words[marked["word"].to_numpy()] = marked["bits"].to_numpy()
    shared = grams.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        gram, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return gram, np.bincount(where, np.concatenate([p[1] for p in parts]), len(gram)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known, parts, held = shared.value, _Hashes(), [], 0
        for part in slices(batches, text, SLICE):
            if len(known) > 500_000:
                known.clear()
            hashes, sizes = [], []
            for t in part.column(text).to_pylist():
                found = list(map(known.__getitem__, _TOKEN.findall(t or "")))
                hashes += found
                sizes.append(len(found))
            one = np.array(hashes, np.uint64)
            inner = np.ones(max(len(one) - 1, 0), bool)
            ends = np.cumsum(sizes)[:-1]
            inner[ends[(ends > 0) & (ends < len(one))] - 1] = False
            inner &= (one[:-1] != 0) & (one[1:] != 0)
            two = one[:-1] * np.uint64(_FIRST) + one[1:] * np.uint64(_SECOND) + np.uint64(_PLUS)
            every = np.concatenate([one[one != 0], two[inner]])
            passed = every[(bits[(every >> np.uint64(6)) & np.uint64(n_words - 1)] >> (every & np.uint64(63))) & np.uint64(1) == 1]
            parts.append(np.unique(passed, return_counts=True))
            held += len(parts[-1][0])
            if held > 1 << 20:
                parts = [added(parts)]
                held = len(parts[0][0])
                if held > 1 << 19:  # they differ, and go on to Spark
                    yield told(parts.pop())
                    held = 0
        if parts:
            yield told(added(parts))

    def told(counts: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts[0].view(np.int64)), pa.array(counts[1].astype(np.int64))], ["gram", "n"])

    counted = map_texts(docs.select(text), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return counted.join(grams.distinct(), "gram")  # an inner join, which Spark leaves after the sums


def _spread(big: DataFrame, small: DataFrame, on: list[str], by: Column, ways: int = 16) -> DataFrame:
    """big joined with small, which has a row for each key: rows of a frequent key are dealt to so many places by `by`."""
    dealt = big.withColumn("_way", F.pmod(F.xxhash64(by), F.lit(ways)).cast("int"))
    copies = small.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return dealt.join(copies, [*on, "_way"]).drop("_way")


def graph(docs: DataFrame, found: DataFrame, *, text: str = "text", support: int = 3) -> DataFrame:
    """(slot, gram, value, seed, kinds, fillers): the edges from patterns (slot, gram) to instances (value), of patterns with at least `support` instances.

    seed: the kinds, as bits, that the base found the instance to be of; kinds: those it may be of; fillers: how many different instances the
    pattern has, and how often it occurs beside something else.
    """
    each = found.select(F.explode("mentions").alias("m")).select("m.*")
    values = each.groupBy("value").agg(F.bit_or(F.when(F.col("kind").isNotNull(), F.col("kinds")).otherwise(0)).alias("seed"), F.bit_or("kinds").alias("kinds"))
    beside = each.select("value", F.posexplode("context").alias("slot", "gram")).where("gram is not null")
    edges = write_table(beside.groupBy("slot", "gram", "value").agg(F.count("*").alias("n")), "pii-beside")
    patterns = write_table(edges.groupBy("slot", "gram").agg(F.count("*").alias("instances"), F.sum("n").alias("n")).where(F.col("instances") >= support), "pii-patterns")
    often = occurrences(docs, patterns.select("gram"), text=text).withColumnRenamed("n", "all")
    told = patterns.join(often, "gram", "left").select("slot", "gram", (F.col("instances") + F.greatest(F.coalesce("all", F.lit(0)) - F.col("n"), F.lit(0))).alias("fillers"))
    kept = _spread(edges.select("slot", "gram", "value"), told, ["slot", "gram"], F.col("value"))
    return write_table(_spread(kept, values, ["value"], F.col("gram")), "pii-graph")


def bootstrap(edges: DataFrame, *, support: int = 3, sure_pattern: int = 500, sure_instance: int = 700, rounds: int = 3) -> tuple[DataFrame, DataFrame | None]:
    """(instances, patterns) of graph(): instances found (value, kind, score), and the patterns of the last round (slot, gram, kind, score). Scores are thousandths.

    A pattern's score: the scores of its known instances over its fillers and one more; it needs as many known instances as `support` and at
    least sure_pattern. An instance's: 1 - (1 - l) (1 - r), l and r its best pattern on either side, at least sure_instance; of kinds of equal score the first.
    """
    spark = edges.sparkSession
    each = F.explode(F.array(*[F.lit(k) for k in range(len(KINDS))]))
    bit = lambda column: F.col(column).bitwiseAND(F.expr("shiftleft(1, kind)")) != 0
    seeds = edges.where("seed <> 0").select("slot", "gram", "fillers", "seed", each.alias("kind")).where(bit("seed")).select("slot", "gram", "fillers", "kind", F.lit(1000).alias("score"))
    others = edges.where("seed = 0").select("slot", "gram", "value", "fillers", "kinds")
    found = spark.createDataFrame([], "value long, kind int, score int")
    patterns = None
    for k in range(rounds):
        known = seeds if patterns is None else seeds.unionByName(_spread(others, found, ["value"], F.col("gram")).select("slot", "gram", "fillers", "kind", "score"))
        sums = known.groupBy("slot", "gram", "kind").agg(F.sum("score").alias("known"), F.first("fillers").alias("fillers"))
        score = F.expr("cast(known div (fillers + 1) as int)")
        patterns = write_table(sums.where(F.col("known") >= support * 1000).select("slot", "gram", "kind", score.alias("score")).where(F.col("score") >= sure_pattern), f"pii-sure{k}")
        kinds = patterns.groupBy("slot", "gram").agg(F.collect_list(F.struct("kind", "score")).alias("is"))  # at most one for each kind
        reached = _spread(others, kinds, ["slot", "gram"], F.col("value")).select("value", "slot", "kinds", F.inline("is")).where(bit("kinds"))
        side = lambda left: F.coalesce(F.max(F.when((F.col("slot") < 2) == left, F.col("score"))), F.lit(0))
        both = reached.groupBy("value", "kind").agg(side(True).alias("l"), side(False).alias("r"))
        scored = both.select("value", "kind", F.expr("cast(1000 - (1000 - l) * (1000 - r) div 1000 as int)").alias("score")).where(F.col("score") >= sure_instance)
        now = scored.groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score"))
        found = write_table(now, f"pii-found{k}")
        if found.isEmpty():
            break
    return found, patterns


def written(spans: Column) -> Column:
    """`kind:start:end`, by start and then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    told = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(told, ",")


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text", support: int = 3, **kw: int) -> DataFrame:
    """(key, base, added): spans (start, kind's number, end; code points, end exclusive) of the base patterns and of the identifiers found beyond them, wherever these stand."""
    found = write_table(mentions(docs, key=key, text=text).withColumn("_row", F.monotonically_increasing_id()), "pii-mentions")
    instances, _ = bootstrap(graph(docs, found, text=text, support=support), support=support, **kw)
    each = found.select("_row", F.explode("mentions").alias("m")).where("m.kind is null").select("_row", "m.value", "m.start", "m.end")
    span = F.struct("start", "kind", "end")
    added = _spread(each, instances.select("value", "kind"), ["value"], F.col("_row")).groupBy("_row").agg(F.collect_list(span).alias("added"))  # of one document
    base = F.transform(F.filter("mentions", lambda m: m["kind"].isNotNull()), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return found.select(key, "_row", base.alias("base")).join(added, "_row", "left").select(key, "base", F.coalesce("added", none).alias("added"))
