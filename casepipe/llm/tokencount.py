"""Token counts by a map-side two-tier lookup, without any shuffle.

Tier one is a table of the lengths of frequent pre-tokens, built once on the
driver from the vocabulary itself (its whole entries are the frequent
pre-tokens of the corpus it was made from) and broadcast; its size is bound
by the vocabulary.  Tier two is a cache in every Python worker: a miss is
encoded with the tokenizers library and remembered.

Texts are cut before blanks, where no pre-token can span (see ``_regular``);
a text with another shape, with characters beyond the checked range or with a
special token's first characters is encoded whole by the library.

Defined cases: null text counts as empty (0 tokens); any text is encoded to
its end; rows with equal ids are counted each; an empty table gives no row;
further columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casepipe.llm.common import flat, text_or_empty

#: Entries of a worker's cache; a full cache is started anew.
CACHE_ENTRIES = 700_000
#: Characters whose class is the same in every Unicode version: anything else sends the text to the library.
UNCHECKED = re.compile("[^\\x00-\\x1b\\x20-\\x7e\\xa1-\\u024f\\u2010-\\u2027]|<\\|")
#: A blank inside a run of white space that is not the run's last character.
_odd = re.compile(r"\s (?!\S)")
#: Letters and numbers of the checked range.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The library's pre-token pattern, on the checked range.
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _regular(text: str) -> bool:
    """True if a pre-token begins at every blank: each blank follows a
    character that is no white space, or is the last of its run of white space."""
    return not UNCHECKED.search(text) and not _odd.search(text)


class PreTokens(dict):
    """Token count by pre-token: a miss runs the library's merges."""

    def __init__(self, tokenizer, first: dict[str, int], limit: int = CACHE_ENTRIES):
        super().__init__(first)
        self.merge, self.first, self.limit = tokenizer.model.tokenize, first, limit
        self.shown = byte_characters()

    def __missing__(self, piece: str) -> int:
        n = len(self.merge("".join(map(self.shown.__getitem__, piece.encode()))))
        if len(piece) <= 64:
            if len(self) >= self.limit + len(self.first):
                self.clear()
                self.update(self.first)
            self[piece] = n
        return n


class Lengths(dict):
    """Token count of the part of a text between two blanks, by the part's
    text; the blank before it belongs to it."""

    def __init__(self, tokenizer, first: dict[str, int], limit: int = CACHE_ENTRIES):
        super().__init__()
        self.tokenizer, self.limit = tokenizer, limit
        self.pieces = PreTokens(tokenizer, first, limit)

    def __missing__(self, part: str) -> int:
        n = sum(map(self.pieces.__getitem__, PRE_TOKEN.findall(" " + part)))
        if len(part) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[part] = n
        return n

    def count(self, text: str) -> int:
        if not _regular(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        parts = iter(text.split(" "))
        n = sum(map(self.pieces.__getitem__, PRE_TOKEN.findall(next(parts))))
        return n + sum(map(self.__getitem__, parts))


def frequent_lengths(path: str) -> dict[str, int]:
    """Lengths of the vocabulary's entries that begin with a blank, as the
    library encodes them."""
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    t = Tokenizer.from_file(path)
    decode = ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False).decode
    words = [w for w in (decode([x]) for x in t.get_vocab() if x.startswith("Ġ")) if w.startswith(" ") and "�" not in w and " " not in w[1:]]
    return {w: len(e) for w, e in zip(words, t.encode_batch(words, add_special_tokens=False), strict=True)}


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` with the tokenizers file at ``path``
    (a path that every executor can read), added tokens as its defaults say."""
    spark = docs.sparkSession
    tier_one = spark.sparkContext.broadcast(frequent_lengths(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        lengths = Lengths(t, tier_one.value)
        for b in batches:
            _, at = flat(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(at[1:] - at[:-1], pa.int64()),
                    pa.array([lengths.count(x.as_py()) for x in b.column(1)], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
