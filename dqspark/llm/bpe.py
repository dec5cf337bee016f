"""Byte-pair encoding with forced boundaries, and decoding.

Two neighbouring byte symbols that stand side by side in no token of the vocabulary can
never be merged into one token, nor can any merge reach across them.  Such pairs cut a
word into fragments which are encoded independently; the ids of a word are those of its
fragments in order.  Fragments are short and recur, so most are found in a table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, with_batches

#: Entries of the tables of known words and fragments, kept by a task; they are emptied when full.
KNOWN = 200_000
#: Characters below this are normalised and split by rules built here; others by the library's own normaliser.
PLAIN = 0x180


#: What the rules built here follow: white space as blanks, lower case, this split, symbols of bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Options of the model that have to be off.
OFF = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")


def refuse_other_rules(spec: dict) -> None:
    """Raise ``ValueError`` for a tokenizer whose file asks for other rules than those followed here."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    same = {
        "normalizer": (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS,
        "pre_tokenizer": len(steps) == 2 and steps[0].get("pattern") == {"Regex": SPLIT} and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
        and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex"),
        "model": spec["model"].get("type") == "BPE" and not any(spec["model"].get(k) for k in OFF),
        "decoder": spec.get("decoder") is None,
        "added_tokens": all(t["content"].startswith("<|") and not (t.get("normalized") or t.get("single_word") or t.get("lstrip") or t.get("rstrip")) for t in spec.get("added_tokens", [])),
    }
    if other := [k for k, v in same.items() if not v]:
        raise ValueError(f"the tokenizer file has another {', '.join(other)} than this encoder follows")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: printable Latin-1 stands for itself, the rest follows from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown, spare = dict.fromkeys(own), 0x100
    symbols = []
    for byte in range(256):
        if byte in shown:
            symbols.append(chr(byte))
        else:
            symbols.append(chr(spare))
            spare += 1
    return symbols


def pack(model, part: str) -> bytes:
    """Ids of a fragment, as the model merges it."""
    return array("I", [token.id for token in model.tokenize(part)]).tobytes()


class Known(dict):
    """Results by key, computed when missing; emptied when full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= KNOWN:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Encodes and decodes as the tokenizer file says; files with other rules than these are refused.

    The library merges within a fragment; where a word is cut, and what its parts are, is
    decided here.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        refuse_other_rules(spec)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # a fragment that ends a word bears the suffix, one within a word does not
        self.ending = models.BPE(vocab=self.vocab, merges=merges, end_of_word_suffix=self.end or None)
        self.within = models.BPE(vocab=self.vocab, merges=merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.joined, self.joined_last = self.inner_pairs()
        self.symbols = byte_symbols()
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        kinds = {c: unicodedata.category(chr(c))[0] for c in range(PLAIN)}
        listed = lambda kind: "".join(re.escape(chr(c)) for c in range(PLAIN) if kinds[c] == kind)
        letters, numbers, blanks = listed("L"), listed("N"), "\t-\r \\x85\\xa0"
        self.plain = re.compile(f"[^\\x00-{chr(PLAIN - 1)}]")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{blanks}{letters}{numbers}]+")
        self.of_fragment = Known(lambda part: pack(self.within, part))
        self.of_last = Known(lambda part: pack(self.ending, part))
        self.of_symbols = Known(self.encode_symbols)
        self.of_word = Known(lambda word: self.encode_symbols("".join(map(self.symbols.__getitem__, word.encode("utf-8", "surrogatepass")))))

    def inner_pairs(self) -> tuple[set[str], set[str]]:
        """Byte pairs that stand side by side in a token: within it, and as the end of a word."""
        within, last = set(), set()
        for token in self.vocab:
            stem = token.removesuffix(self.end) if self.end and token != self.end else token
            pairs = [stem[i : i + 2] for i in range(len(stem) - 1)]
            if stem != token and pairs:
                last.add(pairs.pop())
            within.update(pairs)
        return (within, last) if self.end else (within, within)

    def encode_symbols(self, word: str) -> bytes:
        """Ids of one word of byte symbols, as little-endian unsigned 32-bit integers."""
        size, joined = len(word), self.joined
        cuts = [i for i in range(1, size - 1) if word[i - 1 : i + 1] not in joined]
        if size > 1 and word[-2:] not in self.joined_last:
            cuts.append(size - 1)
        if not cuts:
            return self.of_last[word]
        inner = [self.of_fragment[word[a:b]] for a, b in zip([0, *cuts], cuts, strict=False)]
        return b"".join(inner) + self.of_last[word[cuts[-1] :]]

    def stretch(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if self.plain.search(text):
            pieces = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))
            return b"".join([self.of_symbols[piece] for piece, _ in pieces])
        return b"".join(map(self.of_word.__getitem__, self.words.findall(text.lower())))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.marks is None or "<|" not in text:
            return self.stretch(text)
        special = {k: array("I", [v]).tobytes() for k, v in self.special.items()}
        return b"".join(special.get(part) or self.stretch(part) for part in self.marks.split(text) if part)

    def decode(self, ids: bytes) -> str:
        """Tokens with a blank between them, as a tokenizer without a decoder gives them; special tokens stay."""
        return " ".join(map(self.tokens.__getitem__, array("I", ids)))


def encode(docs: DataFrame, path: str, text: str = "text", keeps: list[str] | None = None) -> DataFrame:
    """Add ``ids``: the whole text's token ids as little-endian unsigned 32-bit integers.

    Null and empty texts give no ids.  Rows are independent, so ties and repeated rows
    need no rule; an existing ``ids`` column is replaced.  ``path`` names a tokenizer file
    that every executor has.
    """

    def start():
        coder = Encoder(path)
        return lambda texts: ([coder.encode(t) for t in texts],)

    return with_batches(docs, [text], docs.columns if keeps is None else keeps, [field("ids", "binary")], start)


def decode(docs: DataFrame, path: str, ids: str = "ids", keeps: list[str] | None = None) -> DataFrame:
    """Add ``decoded``: the text of packed token ids; null ids give an empty text."""

    def start():
        coder = Encoder(path)
        return lambda packed: ([coder.decode(p or b"") for p in packed],)

    return with_batches(docs, [ids], docs.columns if keeps is None else keeps, [field("decoded", "string")], start)


def round_trip(docs: DataFrame, path: str, text: str = "text", keeps: list[str] | None = None) -> DataFrame:
    """Add ``ids`` and ``decoded`` in one pass: the text's packed ids, and those ids decoded."""

    def start():
        coder = Encoder(path)

        def work(texts):
            packed = [coder.encode(t) for t in texts]
            return packed, [coder.decode(ids) for ids in packed]

        return work

    return with_batches(docs, [text], docs.columns if keeps is None else keeps, [field("ids", "binary"), field("decoded", "string")], start)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, number of tokens, and digests of the ids and of the decoded text."""
    coded = round_trip(docs, path, text, [key])
    return coded.select(
        key, (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
