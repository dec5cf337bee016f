"""Language identification by compression against a dictionary of each language.

A text is reduced to lower-case letters and single blanks, cut into chunks, and every
chunk is compressed with one zstandard raw-content dictionary per language.  The language
whose dictionary gives the fewest bytes over the whole text wins.  If the runner-up needs
nearly as few, the margin is narrow; the text is then judged by its different words, each
once, and marked as rejected if the margin stays narrow.
"""

from __future__ import annotations

import math
import re

import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import field, with_batches

UNKNOWN = "und"
#: Bounds of the training sample: texts per language, characters of each, bytes of a dictionary.
SAMPLE_TEXTS, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 128, 32_768
#: Parts of a language that are sampled apart first.
PARTS = 16
#: Bytes compressed at once.  Short enough that the dictionary, not the text before, explains a chunk.
CHUNK = 4096
#: Appended to each chunk: a block that doesn't shrink would be stored raw, the same for every language.
FILLER = b" " + b"0" * 64
#: A text is rejected when the runner-up needs less than this share of bytes more.
MIN_MARGIN = 0.002
#: Share of the code-length difference that counts as evidence; chunks of one text are not independent.
EVIDENCE = 0.25
#: More labels than this are no languages; training on them is refused.
MAX_LANGUAGES = 1000


def letters(text: str | None) -> bytes:
    """Lower-case letters of a text with single blanks between them, in UTF-8."""
    return re.sub(r"[\W\d_]+", " ", text or "").strip().lower().encode("utf-8", "surrogatepass")


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, bytes]:
    """One dictionary per language from a bounded sample of labelled rows.

    The sample holds, for each non-null label, the ``SAMPLE_TEXTS`` texts with the smallest
    key hash, and of each a run of ``SAMPLE_CHARS`` characters at a place the hash picks.
    Rows with a null text or label are not used.  No rows give an empty model.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    piece = F.substring(F.col("text"), (F.pmod(F.col("h"), room) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    # the smallest hashes of each part of a language, then of the language: a language that
    # holds most rows is cut down by many tasks before one sees it
    part = F.pmod(F.col("h"), F.lit(PARTS)).alias("part")
    picked = rows.select("lang", "h", part, piece.alias("piece"))
    for by in (["lang", "part"], ["lang"]):
        picked = picked.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h", "piece"))).where(F.col("n") <= SAMPLE_TEXTS)
    chosen = picked
    sample: dict[str, list[bytes]] = {}
    for row in chosen.orderBy("lang", "n").limit(SAMPLE_TEXTS * MAX_LANGUAGES + 1).collect():
        sample.setdefault(row.lang, []).append(letters(row.piece))
    if len(sample) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    return {name: b" ".join(pieces)[-DICTIONARY_BYTES:] for name, pieces in sample.items()}


def classifier(model: dict[str, bytes], min_margin: float = MIN_MARGIN):
    """A function from texts to (languages, scores, margins, rejected)."""
    names = sorted(name for name, content in model.items() if len(content) >= 8)
    # matches of four bytes, short chains, and tables no larger than a dictionary needs
    setting = zstandard.ZstdCompressionParameters(
        compression_level=3, strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=3, window_log=16, hash_log=14, chain_log=14,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    coders = []
    for name in names:
        content = zstandard.ZstdCompressionDict(model[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=setting)
        coders.append(zstandard.ZstdCompressor(compression_params=setting, dict_data=content))

    def sizes_of(data: bytes) -> list[int]:
        chunks = [data[i : i + CHUNK] + FILLER for i in range(0, len(data), CHUNK)]
        return [sum(len(coder.compress(chunk)) for chunk in chunks) for coder in coders]

    def one(text: str | None):
        data = letters(text)
        if not data or not names:
            return UNKNOWN, 0.0, 0.0, True
        sizes = sizes_of(data)
        low, high = sorted(sizes)[:2] if len(sizes) > 1 else (sizes[0], 2 * sizes[0])
        if high - low < min_margin * low:
            # a passage or a word that a dictionary holds verbatim may decide alone; each word once tells more
            sizes = sizes_of(b" ".join(sorted(set(data.split(b" ")))))
        best = min(range(len(names)), key=sizes.__getitem__)
        rest = [size for i, size in enumerate(sizes) if i != best]
        margin = (min(rest) - sizes[best]) / sizes[best] if rest else 1.0
        score = 1 / (1 + sum(math.exp(-min(700.0, EVIDENCE * 8 * math.log(2) * (size - sizes[best]))) for size in rest))
        return names[best], score, margin, margin < min_margin

    return lambda texts: list(zip(*map(one, texts), strict=True))


def identify(docs: DataFrame, model: dict[str, bytes], text: str = "text", keeps: list[str] | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``rejected`` to every row.

    Null texts and texts without a letter get ``und``, score 0 and are rejected; so does
    every text under an empty model.  Equal sizes go to the alphabetically first language
    and are rejected.  Only ``text`` is read, so clashing names of other columns do no harm.
    """
    fields = [field("lang_pred", "string"), field("score", "double"), field("margin", "double"), field("rejected", "boolean")]
    return with_batches(docs, [text], docs.columns if keeps is None else keeps, fields, lambda: classifier(model, min_margin))
