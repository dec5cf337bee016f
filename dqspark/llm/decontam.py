"""Benchmark decontamination over a distributed positional inverted index.

Windows of the test items are looked up in postings of the training tokens.  Term counts
over the whole corpus tell the two rarest terms of each window; only those terms get
postings (term, row, position), the rarest also with the words around it.  A window's
candidates are the postings of its rarest term, moved by the term's offset to where the
window would start; the list of its second term, moved likewise, is intersected with them,
and the words around confirm the rest.  What misses the phrase but holds most of its words
close by is a proximity match.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import field, pin, row_ids, with_batches
from .substrings import Powers, Words

#: Words of a window, and the share of a window's different words that a proximity match has around the rarest.
WINDOW, NEAR = 10, 0.8
#: Slots of a term filter: two to this power.  The filter that tasks get is a megabyte, whatever the number of terms.
SLOT_BITS = 20
#: Characters of text looked at together, about: enough to vectorise, and little memory in a worker.
CHARS = 200_000
BLANKS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words of a text: runs of digits, ASCII letters in lower case, and anything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(BLANKS).split()


def windows(items: DataFrame, key: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(window, words, items): every different run of ``size`` item words, and the items it stands in.

    An item of fewer words is one window; an item without a word has none.
    """
    words = with_batches(items.select(key, text), [text], [key], [field("words", "array<string>")], lambda: lambda texts: ([[w.decode("utf-8", "surrogatepass") for w in tokens(t)] for t in texts],))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    runs = words.where(F.size("words") > 0).select(key, F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("words"))
    listed = runs.groupBy("words").agg(F.array_sort(F.collect_set(F.col(key).cast("string"))).alias("items"))
    return pin(listed.select(F.sha2(F.array_join("words", " "), 256).alias("window"), "words", "items"))


def read(texts: list[str | None], powers: Powers) -> Words:
    """The words of some texts as :func:`tokens` finds them, with their hashes."""
    return Words([(t or "").encode("utf-8", "surrogatepass").translate(BLANKS) for t in texts], powers)


def slots(words: Words) -> np.ndarray:
    return (words.hash & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def term_filter(terms: DataFrame) -> bytes:
    """One byte per slot, 1 where a term of column ``term`` falls.

    At most 2**17 rows of eight slots each come to the driver.  A term that only shares a
    slot passes too; the joins that follow drop it.
    """

    def slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            held = np.unique(slots(read(batch.column(0).to_pylist(), powers)))
            yield pa.RecordBatch.from_arrays([pa.array(held)], names=["s"])

    bits = terms.select("term").mapInArrow(slotted, "s long").groupBy((F.col("s") / 8).cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1, cast(s % 8 as int))")).alias("bits"))
    flags = bytearray(1 << SLOT_BITS)
    for at, byte in bits.collect():
        flags[at * 8 : at * 8 + 8] = bytes(byte >> i & 1 for i in range(8))
    return bytes(flags)


def some(texts: list[str | None], powers: Powers) -> Iterator[tuple[int, Words]]:
    """Texts as words, about a megabyte at a time: (number of the first, words)."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= CHARS or i + 1 == len(texts):
            yield first, read(texts[first : i + 1], powers)
            first, size = i + 1, 0


def term_counts(docs: DataFrame, text: str, wanted: bytes) -> DataFrame:
    """(term, n) over the whole corpus, of the terms that pass the filter; summed in each task before they move."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, total, powers = np.frombuffer(wanted, dtype=np.uint8), Counter(), Powers()

        def out() -> pa.RecordBatch:
            kept = [(w.decode("utf-8", "surrogatepass"), n) for w, n in total.items()]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["term", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for _, words in some(batch.column(0).slice(at, 256).to_pylist(), powers):
                    hit = np.nonzero(flags[slots(words)])[0]
                    total.update([words.bytes[a:b] for a, b in zip(words.start[hit].tolist(), words.end[hit].tolist(), strict=True)])
                if len(total) > 200_000:
                    yield out()
                    total.clear()
        yield out()

    return docs.select(text).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def plan_windows(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows with their two rarest terms and offsets; those with a term the corpus lacks cannot occur and go."""
    each = found.select("window", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term"))
    rated = each.join(counts, "term").groupBy("window", "size").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("rated"))
    usable = rated.where(F.size("rated") == F.col("size")).select(
        "window", F.col("rated")[0].term.alias("term"), F.col("rated")[0].offset.alias("offset"),
        F.get("rated", F.lit(1)).term.alias("term2"), F.get("rated", F.lit(1)).offset.alias("offset2"),
    )
    return pin(found.join(usable, "window"))


def index(docs: DataFrame, key: str, text: str, first: bytes, second: bytes, size: int = WINDOW) -> DataFrame:
    """(row, key, n_words, postings): a row's postings of the terms that pass either filter.

    Postings of the first filter carry the words around them.  The table is pinned, so the
    row numbers stay what they are.
    """
    reach = size - 1

    def start():
        rare, other, powers = np.frombuffer(first, dtype=np.uint8), np.frombuffer(second, dtype=np.uint8), Powers()

        def work(texts):
            sizes, lists = [], [[] for _ in texts]
            for number, words in some(texts, powers):
                sizes += words.counts.tolist()
                ends = np.cumsum(words.counts)
                at = slots(words)
                flag = rare[at] | other[at] << 1
                hit = np.nonzero(flag)[0]
                owner = words.owner[hit]
                for i, kind, own, low, high in zip(hit.tolist(), flag[hit].tolist(), owner.tolist(), (ends[owner] - words.counts[owner]).tolist(), ends[owner].tolist(), strict=True):
                    left, near = max(low, i - reach), None
                    if kind & 1:
                        near = words.line(left, min(high, i + size)).decode("utf-8", "surrogatepass").split(" ")
                    term = words.bytes[words.start[i] : words.end[i]].decode("utf-8", "surrogatepass")
                    lists[number + own].append({"term": term, "pos": i - low, "left": left - low, "around": near})
            return sizes, lists

        return work

    fields = [field("n_words", "long"), field("postings", "array<struct<term: string, pos: int, left: int, around: array<string>>>")]
    return pin(with_batches(docs, [text], [key], fields, start, rows=64)).withColumn("row", F.monotonically_increasing_id())


def matches(indexed: DataFrame, planned: DataFrame, near: float = NEAR) -> DataFrame:
    """(row, start, size, items, phrase): exact occurrences of windows, and proximity matches with ``phrase`` false."""
    posted = indexed.where(F.size("postings") > 0).select("row", F.explode("postings").alias("p")).select("row", "p.*")
    sought = planned.select("window", "words", "items", "term", "offset", "term2", "offset2")
    moved = posted.where(F.col("around").isNotNull()).join(sought, "term").withColumn("start", F.col("pos") - F.col("offset"))
    close = F.size(F.array_intersect("around", "words")) >= F.ceil(F.lit(near) * F.size(F.array_distinct("words")))
    candidates = moved.where(close)
    second = posted.select("row", F.col("term").alias("term2"), F.col("pos").alias("pos2"))
    lone = candidates.where(F.col("term2").isNull()).withColumn("pos2", F.lit(None).cast("int"))
    both = candidates.where(F.col("term2").isNotNull()).withColumn("pos2", F.col("start") + F.col("offset2"))
    met = both.join(second.distinct().withColumn("met", F.lit(True)), ["row", "term2", "pos2"], "left")
    joined = met.unionByName(lone.withColumn("met", F.lit(True)))
    same = F.slice("around", F.greatest(F.col("start") - F.col("left"), F.lit(0)) + 1, F.size("words")) == F.col("words")
    phrase = F.coalesce("met", F.lit(False)) & (F.col("start") >= F.col("left")) & same
    return joined.select("row", "start", F.size("words").alias("size"), "items", "window", phrase.alias("phrase"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: key, ``n_words``, ``n_hit``, ``items`` (sorted), ``n_near``.

    ``n_hit`` counts words inside any occurrence of a window, ``items`` lists the items with
    an occurring window, ``n_near`` counts proximity matches.  Null and wordless texts have
    no words and no hits; an empty benchmark gives no hits; every row is treated by itself,
    also if its key is null or repeated.  Other columns are not read.
    """
    found = windows(items, item_key, item_text, size)
    terms = found.select(F.explode("words").alias("term"))
    planned = plan_windows(found, term_counts(docs, text, term_filter(terms)))
    chosen = [term_filter(planned.select(F.col(c).alias("term")).where("term is not null")) for c in ("term", "term2")]
    indexed = index(docs, key, text, *chosen, size)
    met = pin(matches(indexed, planned))
    hits = met.where("phrase").select("row", "start", (F.col("start") + F.col("size")).alias("end"), "items")
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), "start")), F.lit(0))
    covered = hits.withColumn("new", new).groupBy("row").agg(
        F.sum("new").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    near = met.where("not phrase").groupBy("row").agg(F.count("*").alias("n_near"))
    joined = indexed.select("row", key, "n_words").join(covered, "row", "left").join(near, "row", "left")
    none = F.array().cast("array<string>")
    return joined.select(key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def keep_clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows without a benchmark phrase, columns as they were.

    Rows are told apart by key and text: a contaminated text does not take other rows with
    it that have the same key, or none either.
    """
    given = row_ids(docs, key, text)
    bad = decontaminate(given.select("_id", F.col("row").getField(text).alias("_text")), items, "_id", "_text").where("n_hit > 0").select("_id").distinct()
    return given.select("row", "_id").join(bad, "_id", "left_anti").select("row.*")
