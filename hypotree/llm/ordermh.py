"""Order MinHash fingerprints, sensitive to edit distance, with DataFrame functions only.

The k-mers are those of a text's UTF-8 bytes. Each is numbered by its occurrence, and each (k-mer, occurrence) gets a
hash of its own. The SMALLEST smallest hashes of the text are selected and fall into 64 cells by their lowest bits; in
each cell the two of smallest rank (the other bits) are put back into text order and hashed together. The cells' hashes
are the fingerprint. Two texts with a small edit distance share most k-mers in the same order, so most cells agree.

K-mers are packed as (hash, place) into longs and sorted, so that Spark's compiled array functions select; only the
k-mers' hashes, the search for repeated ones and the few selected ones need lambda functions.

Defined results: null text is empty; an empty text has the empty fingerprint, which equals itself only; a text shorter
than a k-mer is one k-mer; repeated rows each get a row (equal rows of one document follow each other); an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_tables, ordered_rows, write_table

#: Bits of a k-mer's place (any place in a string), of its rank and of its cell; together 63.
PLACE, RANK, CELL = 31, 26, 6
HASH = RANK + CELL
TOP = (1 << PLACE) - 1
WHOLE = (1 << (HASH + PLACE)) - 1
#: Bits of a cell's hash in the fingerprint.
SKETCH = 25
#: So many (k-mer, occurrence) pairs are selected from a text, if it has them: six for a cell on average.
SMALLEST = 384


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once; a bound binary value or array is also not read from the row at each use, as a column's is."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _if_any(items: str, body: Callable[[Column], Column]) -> Column:
    """body(items), to be given an otherwise(). As the column is named twice, Spark works it out in a step of its own, compiled: under a lambda function it would be interpreted."""
    return F.when(F.size(items) > 0, _let(F.col(items), body))


def _kmers(data: Column, count: Column, before: Column, k: int) -> Column:
    """(hash, place) of `count` k-mers of binary data; places are counted from before + 1."""
    found = _let(data, lambda b: F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.substr(b, i, F.lit(k))).bitwiseAND(F.lit(WHOLE - TOP)).bitwiseOR(i + before)))
    return F.when(count > 0, found).otherwise(F.array().cast("array<bigint>"))


def _count(size: Column, k: int) -> Column:
    return F.when(size == 0, 0).otherwise(F.greatest(size - (k - 1), F.lit(1)))


def _again(x: Column, number: Column) -> Column:
    """(hash, place) of a later occurrence, from that of its k-mer and its number."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.shiftright(x, PLACE), number), 64 - HASH), PLACE).bitwiseOR(x.bitwiseAND(TOP))


def _by_cell(x: Column) -> Column:
    """(cell, rank, place) from (rank, cell, place)."""
    return F.shiftleft(F.shiftright(x, PLACE).bitwiseAND((1 << CELL) - 1), RANK + PLACE).bitwiseOR(F.shiftleft(F.shiftright(x, PLACE + CELL), PLACE)).bitwiseOR(x.bitwiseAND(TOP))


def _cell(x: Column) -> Column:
    return F.shiftright(x, RANK + PLACE)


def _rank(x: Column) -> Column:
    return F.shiftright(x, PLACE).bitwiseAND((1 << RANK) - 1)


def _sketches(sorted_items: str) -> Column:
    """From sorted (cell, rank, place): per cell an int of its number and SKETCH bits of its hash."""

    def of(items: Column) -> Column:
        def sketch(x: Column, i: Column) -> Column:
            y = F.get(items, i + 1)
            turned = x.bitwiseAND(TOP) > y.bitwiseAND(TOP)
            pair = F.xxhash64(F.when(turned, _rank(y)).otherwise(_rank(x)), F.when(turned, _rank(x)).otherwise(_rank(y)))
            hashed = F.when(_cell(y.bitwiseXOR(x)) == 0, pair).otherwise(F.xxhash64(_rank(x)))
            own = F.shiftleft(_cell(x), SKETCH).bitwiseOR(F.shiftrightunsigned(hashed, 64 - SKETCH)).cast("int")
            return F.when(_cell(F.get(items, i - 1).bitwiseXOR(x)) == 0, None).otherwise(own)

        return F.array_compact(F.transform(items, sketch))

    return _if_any(sorted_items, of).otherwise(F.array().cast("array<int>"))


def _numbered(items: Column) -> Column:
    """(hash, place) of later occurrences, from the sorted k-mers that aren't the first of their kind: runs of one hash, each numbered from 1."""
    near = lambda x, i, back: x - F.get(items, i - back) <= TOP
    short = F.transform(items, lambda x, i: _again(x, F.when(near(x, i, 2), 3).when(near(x, i, 1), 2).otherwise(1)))
    begins = F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda i: F.coalesce(F.get(items, i) - F.get(items, i - 1) > TOP, F.lit(True)))

    def runs(begins: Column) -> Column:
        def one(begin: Column, number: Column) -> Column:
            length = F.coalesce(F.get(begins, number + 1), F.size(items)) - begin
            return F.transform(F.slice(items, begin + 1, length), lambda x, i: _again(x, i + 1))

        return F.flatten(F.transform(begins, one))

    return F.when(F.size(F.filter(items, lambda x, i: near(x, i, 3))) == 0, short).otherwise(_let(begins, runs))


def _selected(df: DataFrame, kmers: str, to: str) -> DataFrame:
    """Column `to`: the fingerprint of the sorted k-mers, an array of ints by cell."""
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_later", _let(F.col(kmers), lambda a: F.filter(a, lambda x, i: x - F.get(a, i - 1) <= TOP)))  # next to the same hash
    df = df.withColumn("_more", _if_any("_later", _numbered).otherwise(none))
    first = F.array_except(F.slice(kmers, F.lit(1), F.lit(SMALLEST) + F.size("_later")), "_later")
    df = df.withColumn("_some", F.slice(F.sort_array(F.concat(first, "_more")), 1, SMALLEST))
    df = df.withColumn("_cells", F.sort_array(_if_any("_some", lambda a: F.transform(a, _by_cell)).otherwise(none)))
    return df.withColumn(to, _sketches("_cells")).drop("_later", "_more", "_some", "_cells")


def with_fingerprint(df: DataFrame, text: Column, to: str, *, k: int = 12) -> DataFrame:
    """df with the fingerprint of text in column `to`."""
    df = df.withColumn("_b", F.coalesce(text, F.lit("")).cast("binary"))
    df = df.withColumn("_s", F.sort_array(_kmers(F.col("_b"), _count(F.octet_length("_b"), k), F.lit(0), k))).drop("_b")
    return _selected(df, "_s", to).drop("_s")


def with_both_fingerprints(df: DataFrame, text: str, kept: Column, edited: str, to: str, to_edited: str, *, k: int = 12) -> DataFrame:
    """df with the fingerprints of the texts in two columns whose first `kept` bytes are the same: the k-mers of those are hashed once."""
    df = df.withColumns({"_b": F.col(text).cast("binary"), "_e": F.col(edited).cast("binary"), "_same": F.greatest(kept - (k - 1), F.lit(0)).cast("int")})
    df = df.withColumn("_h", _kmers(F.col("_b"), _count(F.octet_length("_b"), k), F.lit(0), k))
    rest = F.when(F.col("_same") == 0, _count(F.octet_length("_e"), k)).otherwise(F.octet_length("_e") - (k - 1) - F.col("_same"))
    df = df.withColumn("_rest_count", rest)
    tail = _kmers(F.substr("_e", F.col("_same") + 1), F.col("_rest_count"), F.col("_same"), k)
    df = df.withColumns({"_s": F.sort_array("_h"), "_t": F.sort_array(F.concat(F.slice("_h", F.lit(1), F.col("_same")), tail))})
    df = _selected(df.drop("_b", "_e", "_h", "_same", "_rest_count"), "_s", to).drop("_s")
    return _selected(df, "_t", to_edited).drop("_t")


def likeness(a: Column, b: Column) -> Column:
    """The share of cells that agree, of those that either fingerprint has; 1 for two empty ones."""
    cells = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, SKETCH)), F.transform(b, lambda x: F.shiftright(x, SKETCH))))
    return F.when(cells == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / cells)


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def next_in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with the columns of `order` of the next row in that order, named next_...; after the last comes the first."""
    at = ordered_rows(rows, order, "ordermh-order")
    here = F.struct(*order)
    inside = F.lead(here).over(Window.partitionBy("_part").orderBy("_place"))
    first = at.where("_place = 0").select("_part", here.alias("_first"))  # one row for each partition
    after = first.select("_part", F.coalesce(F.lead("_first").over(Window.orderBy("_part")), F.first("_first").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_after"))
    named = at.withColumn("_next", inside).join(F.broadcast(after), "_part").withColumn("_next", F.coalesce("_next", "_after"))
    return named.select(*rows.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in order])


def partitions_for(chars: int) -> int:
    """Partitions of about 4 million characters, as hashing takes time and not memory; larger ones beyond 2,000."""
    return 1 + max(min(chars // 4_000_000, 2000), chars // 128_000_000)


def edited_fingerprints(docs: DataFrame, *, share: int = 4, keep: Callable[[Column], Column] = lambda edited: edited, k: int = 12) -> DataFrame:
    """Per row of docs (doc_id, text): the fingerprints of its text, of its edited text and of the next text.

    Edited is the text with its last 1 / share of code points replaced by the start of the next text in order of doc_id
    (null first, then by the text's hash, equal rows one after another). keep: what of the edited text the column `edited`
    holds. Texts cross the network once, hash-partitioned by document; the starts of the next texts cross it once more.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.select(F.xxhash64("doc_id", "text").alias("h"), F.coalesce("doc_id", F.lit(0)).alias("id"), "doc_id", "text")
    sizes = keyed.select("doc_id", "h", F.char_length("text").cast("long").alias("n_chars")).groupBy("doc_id", "h", "n_chars").agg(F.count("*").alias("copies"))
    sizes = write_table(sizes, "ordermh-sizes")
    total = sizes.agg(F.sum(F.col("n_chars") * F.col("copies")), F.max("copies")).first()
    order = next_in_order(sizes, ["doc_id", "h"]).withColumn("id", F.coalesce("doc_id", F.lit(0))).withColumn("next_id", F.coalesce("next_doc_id", F.lit(0)))
    order = write_table(order, "ordermh-next")
    cut = F.expr(f"n_chars div {share}").cast("int").alias("cut")
    told = [F.col("id").alias("to_id"), F.col("h").alias("to_h"), "doc_id", "n_chars", cut]
    wanted = order.select(F.col("next_id").alias("id"), F.col("next_h").alias("h"), F.lit(False).alias("own"), *told)
    wanted = wanted.unionByName(order.where("copies > 1").select("id", "h", F.lit(True).alias("own"), *told))
    # both joins read the same columns of the same rows, so that Spark shuffles them once and reads that twice
    whole = keyed.select("id", "h", "text").repartition(partitions_for(total[0] or 0), "id", "h")
    whole = whole if (total[1] or 1) == 1 else whole.dropDuplicates(["id", "h"])
    sent = whole.join(wanted, ["id", "h"]).select(F.col("to_id").alias("id"), F.col("to_h").alias("h"), "own", "doc_id", "n_chars", "cut", F.substr("text", F.lit(1), F.col("cut")).alias("start"))
    both = whole.join(sent, ["id", "h"]).withColumn("same", F.substr("text", F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int")))
    both = both.select("id", "h", "own", "doc_id", "n_chars", "text", F.octet_length("same").alias("kept"), F.concat("same", "start").alias("edited"))
    signed = with_both_fingerprints(both, "text", F.col("kept"), "edited", "fingerprint", "edited_fingerprint", k=k)
    signed = write_table(signed.select("id", "h", "own", "doc_id", "n_chars", "fingerprint", "edited_fingerprint", keep(F.col("edited")).alias("edited")), "ordermh-signed")
    drop_tables(sizes)
    by_next = signed.where("not own").select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("fingerprint").alias("next_fingerprint"))
    columns = ["doc_id", "n_chars", "fingerprint", "edited_fingerprint", "next_fingerprint", "edited"]
    found = signed.where("not own").join(order.select("id", "h", "next_id", "next_h"), ["id", "h"]).join(by_next, ["next_id", "next_h"]).select(*columns)
    if (total[1] or 1) == 1:
        return found
    again = signed.where("own").join(order.select("id", "h", "copies"), ["id", "h"]).withColumn("next_fingerprint", F.col("fingerprint"))
    return found.union(again.withColumn("_copy", F.explode(F.sequence(F.lit(2).cast("long"), F.col("copies")))).select(*columns))
