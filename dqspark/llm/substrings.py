"""Substring deduplication with suffix automata of reference shards.

Every document is reference and query: words that a document shares with one of a smaller
key, in a run of at least the threshold, go.

Reference shards.  All windows of the threshold's length that are equal have the same seed,
the smallest of the hashes of their short runs of words.  Windows next to each other that
take their seed from the same place form a piece, of bounded length.  Pieces whose seed
occurs in one text only cannot repeat and go no further.  The other pieces, each different
one once with the smallest key it occurs under, are dealt by seed into shards of bounded
size, so a window and all its equals meet in one shard.

Matching statistics.  A shard's task builds the suffix automaton of its pieces, with the
smallest key of each state, and streams the pieces through it: at every word the state of
the longest match that ends there is known, and where that match reaches the threshold, the
smallest key that the last words of it occur under.  An automaton is kept where its shard is
and not sent to all tasks, since every shard sent to every document would read the corpus
once per shard.

Documents are told apart by text, so copies are one piece of work, and a text that occurs
under a smaller key too goes as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import field, pin, with_batches

#: Words of the shortest run that counts as repeated, and words of a run that seeds are taken from.
SIZE, RUN = 13, 4
#: Pieces that a shard should get, and texts that share a seed above which its windows are dealt out one by one.
SHARD, HOT = 4096, 16_384
#: Seeds that a task puts together, and pieces that it collects, before they move.
PAIRS, HELD = 1_000_000, 20_000
#: Text hashes that a task remembers, so that copies it meets again are hashed once.
SEEN = 1_000_000
#: Bytes of text looked at together, about.
BYTES = 1_000_000
#: Bits of a run's place in the order of runs; the bits above order by hash.
PLACE = 28
BLANK = r"[\x20\x09-\x0D]+"
SPANS = "array<struct<start: int, end: int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as many as asked for so far."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base = np.array([base, pow(base, -1, 1 << 64)], dtype=np.uint64)
        self.powers = np.ones((2, 1), dtype=np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if self.powers.shape[1] < n:
            steps = np.repeat(self.base[:, None], n, axis=1)
            steps[:, 0] = 1
            self.powers = np.cumprod(steps, axis=1, dtype=np.uint64)
        return self.powers[:, :n]


class Words:
    """The words of some texts: the bytes, and of each word its text, start, end and hash.

    A word's hash is a polynomial of its bytes, taken for all words at once.  Hashes only
    deal out work; words are compared as they are.
    """

    def __init__(self, texts: list[bytes], powers: Powers):
        self.bytes = b"\n".join(texts)
        data = np.frombuffer(self.bytes, dtype=np.uint8)
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
        self.start, self.end = np.nonzero(inside[1:-1] & ~inside[:-2])[0], np.nonzero(inside[1:-1] & ~inside[2:])[0] + 1
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.counts = np.diff(np.searchsorted(self.start, offsets))
        self.owner = np.repeat(np.arange(len(texts)), self.counts)
        self.hash = np.zeros(len(self.start), dtype=np.uint64)
        at = 0
        while at < len(self.start):
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + BYTES)))
            low = self.start[at]
            own = data[low : self.end[to - 1]].astype(np.uint64) + np.uint64(1)
            up, down = powers(len(own))
            sums = np.zeros(len(own) + 1, dtype=np.uint64)
            np.cumsum(own * up, out=sums[1:])
            a, b = self.start[at:to] - low, self.end[at:to] - low
            self.hash[at:to] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
            at = to

    def line(self, first: int, last: int) -> bytes:
        """Words first to last, last exclusive, joined by one blank."""
        return b" ".join(self.bytes[self.start[first] : self.end[last - 1]].split())


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def pieces(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, seed, word, windows) of every piece: ``windows`` runs of ``size`` words, the first at that word.

    The seed depends on the words of a window only: of its short runs the one with the
    smallest hash, the first of equal ones.  A piece ends where its windows' seed moves.
    """
    run, total = min(RUN, size), len(words.start)
    none = np.zeros(0, dtype=np.int64)
    if total < size:
        return none, none, none, none
    made = np.zeros(total - run + 1, dtype=np.uint64)
    for i in range(run):
        made = mixed(made + words.hash[i : total - run + 1 + i] + np.uint64(i + 1))
    place = np.uint64((1 << PLACE) - 1)
    least = (made & ~place) | np.arange(len(made), dtype=np.uint64)
    width, span = size - run + 1, 1
    while span < width:  # least of spans of 1, 2, 4 … and at last of the width
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    windows = len(least)
    inside = words.owner[:windows] == words.owner[size - 1 : size - 1 + windows]
    at = (least & place).astype(np.int64)
    first = inside & np.concatenate([[True], (at[1:] != at[:-1]) | ~inside[:-1]])
    begins = np.nonzero(first)[0]
    if not len(begins):
        return none, none, none, none
    return words.owner[begins], made[at[begins]].view(np.int64), begins, np.add.reduceat(inside.astype(np.int64), begins)


def grouped(texts: list[str | None], powers: Powers) -> Iterator[tuple[int, Words]]:
    """Texts as words, about a megabyte at a time: (number of the first, words)."""
    held, first, count = [], 0, 0
    for i, text in enumerate(texts):
        held.append((text or "").encode("utf-8", "surrogatepass"))
        count += len(held[-1])
        if count >= BYTES:
            yield first, Words(held, powers)
            held, first, count = [], i + 1, 0
    if held:
        yield first, Words(held, powers)


def seeds(texts: DataFrame, size: int) -> DataFrame:
    """(seed, h, n, known): the seeds of each text of ``_text``; ``h`` is a hash of the text.

    A task puts the seeds of many texts together first.  A seed that it finds in several
    texts is known to be shared for each of them; besides, one row of every seed, with the
    number of its texts, goes on to meet those of other tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen, held, count = Powers(), set(), [], 0

        def out() -> pa.RecordBatch:
            seed, h = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((h, seed))
            seed, h = seed[order], h[order]
            new = np.ones(len(seed), dtype=bool)  # different (seed, h)
            new[1:] = (seed[1:] != seed[:-1]) | (h[1:] != h[:-1])
            seed, h = seed[new], h[new]
            first = np.nonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))[0]
            n = np.diff(np.append(first, len(seed)))
            known = np.repeat(n > 1, n)
            columns = [np.concatenate([seed[first], seed[known]]), np.concatenate([h[first], h[known]]), np.concatenate([n, np.zeros(known.sum(), np.int64)]), np.repeat([False, True], [len(first), known.sum()])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["seed", "h", "n", "known"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                new = [i for i, h in enumerate(part.column(0).to_pylist()) if h not in seen and (seen.add(h) or True)]
                part = part.take(pa.array(new, pa.int64()))
                if len(seen) > SEEN:
                    seen.clear()
                hs = part.column(0).to_numpy(zero_copy_only=False)
                for first, words in grouped(part.column(1).to_pylist(), powers):
                    owner, seed, _, _ = pieces(words, size)
                    if len(seed):
                        held.append((seed, hs[first + owner]))
                        count += len(seed)
                    if count > PAIRS:
                        yield out()
                        held, count = [], 0
        if held:
            yield out()

    return texts.select("h", "_text").mapInArrow(run, "seed long, h long, n long, known boolean")


def shared_seeds(found: DataFrame, hot: int = HOT) -> DataFrame:
    """(h, found): for each text hash the seeds that another text has too, with the number of parts their windows are dealt into.

    Rows of one seed meet in one task, at most one from each group of texts that
    :func:`seeds` took together; seeds known to be shared keep out of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64) for _ in range(3)]

        def settled(seed, h, n, known) -> pa.RecordBatch:
            first = np.nonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))[0] if len(seed) else np.zeros(0, np.int64)
            each = np.diff(np.append(first, len(seed)))
            total, shared = (np.add.reduceat(n, first), np.minimum.reduceat(h, first) != np.maximum.reduceat(h, first)) if len(first) else (each, each > 1)
            told = np.repeat(shared | (total > hot), each)
            columns = [np.concatenate([seed[told], known[0]]), np.concatenate([h[told], known[1]]), np.concatenate([np.repeat(total, each)[told], np.zeros(len(known[0]), np.int64)])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["seed", "h", "n"])

        for batch in batches:
            seed, h, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            known = batch.column(3).to_numpy(zero_copy_only=False)
            own = [np.concatenate([r, c[~known]]) for r, c in zip(rest, (seed, h, n), strict=True)]
            open_ = len(own[0]) and int(np.searchsorted(own[0], own[0][-1]))  # the last seed may go on in the next batch
            rest = [c[open_:] for c in own]
            yield settled(*[c[:open_] for c in own], (seed[known], h[known]))
        yield settled(*rest, (np.zeros(0, np.int64), np.zeros(0, np.int64)))

    dealt_ = found.repartition(F.when(F.col("known"), F.col("h")).otherwise(F.col("seed"))).sortWithinPartitions("known", "seed")
    met = dealt_.mapInArrow(run, "seed long, h long, n long")
    many = met.where(F.col("n") > hot).select("seed", F.ceil(F.col("n") / hot).cast("int").alias("parts")).distinct()
    parts = F.coalesce("parts", F.lit(1))
    return met.select("seed", "h").join(many, "seed", "left").groupBy("h").agg(F.collect_set(F.struct("seed", parts.alias("parts"))).alias("found"))


class Wanted:
    """The shared seeds of some texts, and which pieces have one."""

    def __init__(self, lists: pa.ListArray):
        number, flat = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()
        name = self.name(flat.field("seed").to_numpy(zero_copy_only=False), number)
        order = np.argsort(name)
        self.names, self.parts = name[order], flat.field("parts").to_numpy(zero_copy_only=False)[order]

    @staticmethod
    def name(seed: np.ndarray, number: np.ndarray) -> np.ndarray:
        return mixed(seed.astype(np.uint64) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def of(self, seed: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Parts of each seed, 0 where it is not shared."""
        asked = self.name(seed, number)
        at = np.minimum(np.searchsorted(self.names, asked), max(0, len(self.names) - 1))
        return np.where(self.names[at] == asked, self.parts[at], 0) if len(self.names) else np.zeros(len(seed), np.int32)


def lines(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """(rows, row, start, seed, part, line) of each shared piece of each text, a group of texts at a time.

    Where very many texts share a seed its windows are pieces by themselves, and their own
    hash tells the part: contexts of a hot phrase that differ then lie in many shards.
    """
    powers = Powers()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256)
            wanted = Wanted(rows.column(3))
            for first, words in grouped(rows.column(2).to_pylist(), powers):
                owner, seed, word, count = pieces(words, size)
                parts = wanted.of(seed, first + owner)
                kept = np.nonzero(parts)[0]
                owner, seed, word, count, parts = owner[kept], seed[kept], word[kept], count[kept], parts[kept]
                start = word - np.concatenate([[0], np.cumsum(words.counts)])[owner]
                found = []
                for o, s, w, n, p, b in zip(*(c.tolist() for c in (owner, seed, word, count, parts, start)), strict=True):
                    if p == 1:
                        found.append((first + o, b, s, 0, words.line(w, w + n + size - 1)))
                    else:
                        windows = [words.line(w + i, w + i + size) for i in range(n)]
                        found += [(first + o, b + i, s, xxhash.xxh3_64_intdigest(line) % p, line) for i, line in enumerate(windows)]
                yield rows, found


def different_pieces(candidates: DataFrame, size: int) -> DataFrame:
    """(seed, part, key, words): the shared pieces, each different one once from each of a task's groups of texts, under its smallest key."""
    kind = candidates.schema["first"]
    schema = T.StructType([field("seed", "long"), field("part", "int"), T.StructField("key", kind.dataType), field("words", "binary")])
    arrow, names = [to_arrow_type(f.dataType) for f in schema], schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}

        def out() -> pa.RecordBatch:
            rows = [(seed, part, key, line) for line, (seed, part, key) in held.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(arrow)], names=names)

        for rows, found in lines(batches, size):
            keys = rows.column(1).to_pylist()
            for row, _, seed, part, line in found:
                key, old = keys[row], held.get(line)
                if old is None or old[2] is None or (key is not None and key < old[2]):
                    held[line] = seed, part, key
            if len(held) > HELD:
                yield out()
                held = {}
        yield out()

    return candidates.select("tid", "first", "_text", "found").mapInArrow(run, schema)


def occurrences(candidates: DataFrame, size: int) -> DataFrame:
    """(tid, first, digest, start): where the shared pieces stand."""
    schema = T.StructType([*candidates.select("tid", "first").schema, field("digest", "binary"), field("start", "int")])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in lines(batches, size):
            index = pa.array([f[0] for f in found], pa.int64())
            digests = pa.array([xxhash.xxh3_128_digest(f[4]) for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0).take(index), rows.column(1).take(index), digests, pa.array([f[1] for f in found], pa.int32())], names=names)

    return candidates.select("tid", "first", "_text", "found").mapInArrow(run, schema)


class Automaton:
    """The suffix automaton of several word sequences, with the smallest rank that each state's words end under."""

    def __init__(self):
        self.next, self.link, self.length, self.first, self.last = [{}], [-1], [0], [None], 0

    def add(self, words: list, rank: int) -> None:
        self.last = 0
        for word in words:
            self.extend(word)
            if self.first[self.last] is None or rank < self.first[self.last]:
                self.first[self.last] = rank

    def state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(None)
        return len(self.next) - 1

    def extend(self, word) -> None:
        """Follow or add one more word after the last state."""
        p = self.last
        q = self.next[p].get(word)
        if q is not None:
            self.last = q if self.length[q] == self.length[p] + 1 else self.split(p, word, q)
            return
        new = self.state(self.length[p] + 1, {}, 0)
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self.split(p, word, q)
        self.last = new

    def split(self, p: int, word, q: int) -> int:
        clone = self.state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def close(self) -> None:
        """Hand the smallest ranks on to the states of shorter words."""
        for q in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            p, rank = self.link[q], self.first[q]
            if rank is not None and (self.first[p] is None or rank < self.first[p]):
                self.first[p] = rank

    def statistics(self, words: list, size: int) -> Iterator[tuple[int, int | None]]:
        """For each word (length, rank): the longest match that ends there, counted to ``size``, and the smallest rank it ends under."""
        state, length = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            while self.length[self.link[state]] >= size if state else False:
                state = self.link[state]
                length = self.length[state]
            yield min(length, size), self.first[state] if state else None


def first_keys(lines: list[bytes], keys: list, size: int) -> list[list]:
    """For each piece the smallest key that each of its windows occurs under; None is the largest key."""
    ranked = sorted({k for k in keys if k is not None})
    rank = {k: i for i, k in enumerate(ranked)} | {None: len(ranked)}
    codes: dict[bytes, int] = {}
    lists = [[codes.setdefault(w, len(codes)) for w in line.split(b" ")] for line in lines]
    automaton = Automaton()
    for words, key in zip(lists, keys, strict=True):
        automaton.add(words, rank[key])
    automaton.close()
    ranked.append(None)
    return [[ranked[r] for n, r in automaton.statistics(words, size) if n >= size] for words in lists]


def repeats(docs: DataFrame, key: str, text: str, size: int = SIZE, shard: int = SHARD, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(texts, found): the smallest key of each different text, and what each repeats of earlier ones.

    ``texts`` has ``tid`` and ``first``.  ``found`` has ``tid``, ``_text`` and ``hits``: pairs of
    (start, mask), bit i of a mask meaning that the window at word start + i occurs under a
    key smaller than ``first``.  A text may come out more than once where rows repeat.
    ``docs`` is read several times and must give the same rows each time, as a table does.
    """
    given = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), text_id(text).alias("tid"))
    texts = pin(given.groupBy("tid").agg(F.min("key").alias("first")))
    wanted = pin(shared_seeds(seeds(given.select(F.xxhash64("tid").alias("h"), "_text"), size), hot))
    shards = max(1, -(-(wanted.agg(F.sum(F.size("found"))).first()[0] or 0) // shard))
    listed = texts.withColumn("h", F.xxhash64("tid")).join(wanted, "h").select(F.col("tid").alias("_tid"), "first", "found")
    same = (F.col("tid") == F.col("_tid")) & F.col("key").eqNullSafe(F.col("first"))  # a text counts under its smallest key
    # read thrice with the same columns, so that one exchange of the texts serves all
    candidates = given.join(listed, same).select("tid", "first", "_text", "found")
    kind = given.schema["key"].dataType
    schema = T.StructType([field("digest", "binary"), T.StructField("keys", T.ArrayType(kind))])
    list_kind = to_arrow_type(schema["keys"].dataType)

    def match(group: pa.Table) -> pa.Table:
        held: dict[bytes, object] = {}
        for line, key in zip(group.column("words").to_pylist(), group.column("key").to_pylist(), strict=True):
            old = held.get(line, key)
            held[line] = key if old is None or (key is not None and key < old) else old
        found = first_keys(list(held), list(held.values()), size)
        return pa.table([pa.array([xxhash.xxh3_128_digest(w) for w in held], pa.binary()), pa.array(found, list_kind)], names=schema.names)

    dealt_ = different_pieces(candidates, size).select(F.pmod(F.xxhash64("seed", "part"), F.lit(shards)).alias("shard"), "key", "words")
    matched = dealt_.groupBy("shard").applyInArrow(match, schema)
    mask = F.expr("aggregate(transform(keys, (k, i) -> if(k is not null and (first is null or k < first), shiftleft(1, i), 0)), 0, (a, b) -> a | b)")
    met = occurrences(candidates, size).join(matched, "digest")
    hits = met.select("tid", "start", mask.alias("mask")).where("mask <> 0").groupBy("tid").agg(F.collect_set(F.struct("start", "mask")).alias("hits"))
    return texts, candidates.select("tid", "first", "_text", "found").join(hits, "tid")


def text_id(text: str) -> Column:
    """A digest of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def covered(hits: list, size: int) -> list[tuple[int, int]]:
    """Maximal spans [start, end) of the words that the hit windows cover."""
    spans: list[tuple[int, int]] = []
    for at in sorted({h["start"] + i for h in hits for i in range(h["mask"].bit_length()) if h["mask"] >> i & 1}):
        if spans and at <= spans[-1][1]:
            spans[-1] = spans[-1][0], at + size
        else:
            spans.append((at, at + size))
    return spans


def without(words: list[bytes], spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *[p for span in spans for p in span], len(words)]
    return b" ".join(w for a, b in zip(ends[::2], ends[1::2], strict=True) for w in words[a:b])


def later() -> Column:
    """Whether a row's text occurs under a smaller key."""
    return F.col("first").isNotNull() & (F.col("key").isNull() | (F.col("key") > F.col("first")))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``spans`` and ``kept_text``; new columns replace given ones of the same name.

    A word goes if a run of ``size`` words of its document that holds it also occurs in a
    document with a smaller key.  ``spans`` are the maximal runs that go, as (start, end) in
    words, end exclusive; ``kept_text`` is the other words joined by one blank.  Runs are
    judged on the given texts, not on what is left of them.

    Null and blank texts have no words.  Rows of equal keys never take words from each
    other.  A null key is larger than any other.  Repeated rows come out as often as they
    came in.  An empty table gives no rows.
    """
    added = ["n_words", "n_removed", "spans", "kept_text"]
    texts, found = repeats(docs, key, text, size)
    judged = with_batches(found, ["hits"], ["tid"], [field("spans", SPANS)], lambda: lambda lists: ([covered(h, size) for h in lists],)).dropDuplicates(["tid"])
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key"), text_id(text).alias("tid"), F.col(text).alias("_text"))
    joined = rows.join(texts.join(judged, "tid", "left"), "tid")

    def start():
        def work(given, spans, flags):
            lists = [words_of(t) for t in given]
            gone = [[(0, len(w))] if flag and len(w) >= size else [(s["start"], s["end"]) for s in own or []] for w, own, flag in zip(lists, spans, flags, strict=True)]
            kept = [without(w, g).decode("utf-8", "surrogatepass") for w, g in zip(lists, gone, strict=True)]
            return [len(w) for w in lists], [sum(b - a for a, b in g) for g in gone], gone, kept

        return work

    fields = [field("n_words", "long"), field("n_removed", "long"), field("spans", SPANS), field("kept_text", "string")]
    marked = joined.withColumn("later", later())
    made = with_batches(marked, ["_text", "spans", "later"], ["row"], fields, start)
    return made.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in added], *added)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every row, as :func:`dedup` would leave it.

    Only the texts that repeat something are moved; those of the rest are read where they lie.
    """
    texts, found = repeats(docs, key, text, size)

    def start():
        def work(given, hits):
            lists, gone = [words_of(t) for t in given], [covered(h, size) for h in hits]
            return [sum(b - a for a, b in g) for g in gone], [hashlib.sha256(without(w, g)).hexdigest() for w, g in zip(lists, gone, strict=True)]

        return work

    judged = with_batches(found, ["_text", "hits"], ["tid"], [field("removed", "long"), field("sha", "string")], start).dropDuplicates(["tid"])
    line = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANK, " "))
    plain = docs.select(F.col(key).alias("key"), text_id(text).alias("tid"), line.alias("line"))
    n_words = F.when(F.col("line") == "", 0).otherwise(F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1)
    rows = plain.select("key", "tid", n_words.cast("long").alias("n_words"), F.sha2(F.col("line").cast("binary"), 256).alias("whole"))
    joined = rows.join(texts.join(judged, "tid", "left"), "tid")
    gone = later() & (F.col("n_words") >= size)
    return joined.select(
        F.col("key").alias(key), "n_words", F.when(gone, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
    )
